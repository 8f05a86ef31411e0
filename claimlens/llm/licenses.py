"""License scans: canonical digest lookup.

A text's canonical form is lower case, without copyright lines, punctuation and
extra white space, and with one spelling for equivalent words.  Its SHA-256 is
joined to the digests of known licences, so only entire texts match, however
they are wrapped.  Of short licences the wording is given, of long ones the
digest of the canonical form; ``scan`` takes any other table of digests.  Short
licence notices are known too: the digests of a text's lines are looked up.

All of it is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

# The wording of well-known licences, without their copyright lines.
WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
    "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
BSD_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution.\n"
)
ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
LICENSES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + WARRANTY,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
    "and this permission notice appear in all copies.\n" + ISC_WARRANTY,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + ISC_WARRANTY,
    "MIT-0": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so.\n" + WARRANTY,
    "Unlicense": "This is free and unencumbered software released into the public domain.\n"
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial "
    "or non-commercial, and by any means.\n"
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We "
    "make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
    "relinquishment in perpetuity of all present and future rights to this software under copyright law.\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A '
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n"
    "For more information, please refer to <https://unlicense.org>",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this "
    "software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to "
    "the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in "
    "a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not "
    "be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
    "BSD-2-Clause": BSD_CLAUSES + BSD_WARRANTY,
    "BSD-3-Clause": BSD_CLAUSES
    + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific "
    "prior written permission.\n" + BSD_WARRANTY,
}
# Titles that may precede a licence's text.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "ISC": ["ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "MIT-0": ["MIT No Attribution", "MIT No Attribution License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "Zlib": ["zlib License", "The zlib License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License"],
}
KNOWN = [*LICENSES.items(), *((k, f"{title}\n{v}") for k, v in LICENSES.items() for title in TITLES[k])]
# SHA-256 of the canonical forms of long licences, as their publishers' plain texts have them.
DIGESTS = {
    "Apache-2.0": "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543",
    "Artistic-1.0-Perl": "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2",
    "CC0-1.0": "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",
    "GFDL-1.2": "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71",
    "GFDL-1.3": "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6",
    "GPL-1.0": "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
    "GPL-2.0": "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    "GPL-3.0": "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68",
    "LGPL-2.0": "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    "LGPL-2.1": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1",
    "MPL-2.0": "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
}
# One-line notices and the licence they name.
NOTICES = {
    "Released under the MIT License.": "MIT",
    "Licensed under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
}
# Equivalent spellings, in canonical form (lower case, no punctuation).
SPELLINGS = {
    "licence": "license",
    "licenced": "licensed",
    "licences": "licenses",
    "sub license": "sublicense",
    "sub licence": "sublicense",
    "sublicence": "sublicense",
    "non commercial": "noncommercial",
    "non infringement": "noninfringement",
    "organisation": "organization",
    "favour": "favor",
    "acknowledgement": "acknowledgment",
    "copyright owner": "copyright holder",
    "per cent": "percent",
    "merchantibility": "merchantability",
}
#: A line that is a copyright statement: it names a year (or its placeholder), has a sign, or names a holder after "by".
COPYRIGHT_LINE = (
    r"(^|\n)[ \t]*((copyright|copr\.)[ \t:]*(\(c\)|©|[12][0-9]{3}|\[yyyy\]|\[year\]|<year>|\{yyyy\}|by[ \t])[^\n]*"
    r"|(\(c\)|©)[ \t]*((copyright|copr\.)[ \t]*)?([12][0-9]{3}|<year>|\[year\])[^\n]*|all rights reserved[^\n]*)"
)
#: What is no letter, digit or mark becomes one space.
BETWEEN_WORDS = r"[^\p{L}\p{M}\p{N}]+"


def canonical(text: Column) -> Column:
    """The canonical form: words joined by single spaces."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, r"$1")
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, BETWEEN_WORDS, " ")), F.lit(" "))
    for spelling, usual in SPELLINGS.items():
        out = F.replace(out, F.lit(f" {spelling} "), F.lit(f" {usual} "))
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known(spark: SparkSession, licenses: list[tuple[str, str]] = KNOWN, digests: dict[str, str] = DIGESTS) -> DataFrame:
    """(license_id, digest) of licences given by their texts or by their canonical forms' digests; of a fixed size."""
    rows = F.array(*[F.struct(F.lit(k).alias("license_id"), F.lit(v).alias("text")) for k, v in licenses])
    one = spark.range(1, numPartitions=1).select(F.explode(rows).alias("r")).select("r.license_id", digest(F.col("r.text")).alias("digest"))
    if digests:
        given = F.array(*[F.struct(F.lit(k).alias("license_id"), F.lit(v).alias("digest")) for k, v in digests.items()])
        one = one.unionByName(spark.range(1, numPartitions=1).select(F.explode(given).alias("r")).select("r.license_id", "r.digest"))
    return one.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", table: DataFrame | None = None) -> DataFrame:
    """key, digest, license_id (null if the whole text is no known licence), notices of every row.

    table: (license_id, digest) of other licences than ``known``; it is joined
    by hash, and broadcast only as ``known``, whose size is fixed.  notices:
    the licences that lines of the text name, distinct, in order, joined by
    commas; empty if none.  A null text counts as empty, which is no licence.
    Every input row, repeated ones too, gives one row; other columns are
    ignored.
    """
    if table is None:
        table = F.broadcast(known(docs.sparkSession))
    else:
        table = table.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("license_id").alias("license_id"))
    named = F.array(*[F.struct(digest(F.lit(k)).alias("digest"), F.lit(v).alias("license")) for k, v in NOTICES.items()])
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: F.lower(x).contains("licen"))
    forms = F.transform(lines, digest)
    notices = F.array_sort(F.array_distinct(F.transform(F.filter(named, lambda n: F.array_contains(F.col("_forms"), n["digest"])), lambda n: n["license"])))
    rows = docs.select(F.col(key), text_of(text).alias("_text")).select(key, digest(F.col("_text")).alias("digest"), forms.alias("_forms"))
    return rows.join(table, "digest", "left").select(key, "digest", "license_id", F.array_join(notices, ",").alias("notices"))
