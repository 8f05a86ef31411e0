"""Whole licences are found however they are wrapped, by digests that an own canonical form gives too."""

import hashlib
import os
import re
import textwrap

import pytest
from claimlens.llm import licenses

PLAIN = "/usr/share/common-licenses"
FILES = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}


def _own_digest(text):
    """Line by line, in plain Python."""
    kept = []
    for line in text.lower().split("\n"):
        head = line.strip(" \t")
        signed = re.match(r"(?:copyright|copr\.)[ \t:]*(?:\(c\)|©|[12]\d{3}|\[yyyy\]|\[year\]|<year>|\{yyyy\}|by[ \t])", head) or re.match(
            r"(?:\(c\)|©)[ \t]*(?:(?:copyright|copr\.)[ \t]*)?(?:[12]\d{3}|<year>|\[year\])", head
        )
        if not signed and not head.startswith("all rights reserved"):
            kept.append(line)
    words = " ".join("".join(c if c.isalnum() else " " for c in "\n".join(kept)).split())
    for spelling, usual in licenses.SPELLINGS.items():
        words = f" {words} ".replace(f" {spelling} ", f" {usual} ").strip()
    return hashlib.sha256(words.encode()).hexdigest()


def _wrapped(text, width):
    return "Copyright (c) 2021 Somebody\n\n" + "\n\n".join(textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in text.split("\n"))


def test_short_licenses_in_any_wrapping(spark):
    rows = [(f"{k}/{w}", _wrapped(v, w)) for k, v in licenses.LICENSES.items() for w in (30, 62, 79, 200)]
    rows += [(f"{k}/{t}", f"{t}\n\n  Copyright 1999-2020 A. B. and others\nCopyright by C\n\n{v.upper()}") for k, v in licenses.LICENSES.items() for t in licenses.TITLES[k]]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert len(got) == len(rows) and all(r.license_id == r.doc_id.split("/")[0] for r in got), [r for r in got if r.license_id != r.doc_id.split("/")[0]]


@pytest.mark.skipif(not os.path.isdir(PLAIN), reason="no licence texts on this machine")
def test_long_licenses(spark):
    rows = []
    for name, want in FILES.items():
        text = open(f"{PLAIN}/{name}").read()
        assert _own_digest(text) == licenses.DIGESTS[want]
        rows += [(want, text), (want, text.replace("license", "licence").replace(", ", " , ").replace("\n", "\r\n")), (f"not {want}", text[:-60]), (f"not {want}", f"{text} more")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert [r for r in got if r.license_id != (None if r.doc_id.startswith("not ") else r.doc_id)] == []


def test_a_wrapped_copyright_notice_is_no_copyright_line(spark):
    isc = licenses.LICENSES["ISC"].replace("the above copyright", "the above\ncopyright")
    table = spark.createDataFrame([("own", hashlib.sha256(b"some words").hexdigest()), (None, None)], "license_id string, digest string")
    docs = spark.createDataFrame([(1, isc), (2, "Some, WORDS!"), (3, None), (4, "")], "doc_id long, text string")
    assert {r.doc_id: r.license_id for r in licenses.scan(docs).collect()} == {1: "ISC", 2: None, 3: None, 4: None}
    assert {r.doc_id: r.license_id for r in licenses.scan(docs, table=table).collect()} == {1: None, 2: "own", 3: None, 4: None}
