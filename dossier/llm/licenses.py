"""Operator 6: licence scans by canonical digests, in DataFrame functions only.

A text is brought to a canonical form (lower case, no copyright lines, equivalent spellings made one, punctuation and
white space squeezed to single blanks) and its SHA-256 is hash-joined to the digests of known licences. Entire texts
are looked up: each document as a whole, and each line as a text of its own, since notices are single lines. The known
list is a fixed table of this module (or the caller's), broadcast only up to KNOWN_ROWS rows and otherwise joined by
a shuffle.

Nulls: a null or empty text, and a line without letters or digits, matches nothing; a null id is carried through.
Repeated rows give repeated matches. Other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known lists of up to so many rows are broadcast (a digest and an id each).
KNOWN_ROWS = 100_000
COPYRIGHT = r"^[^a-z0-9©]*(portions )?(copyright|\(c\)|©)[ ,:]*(\(c\)|©|[0-9]{4}|by )"
PUNCTUATION = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
# Equivalent spellings, applied in this order.
SPELLINGS = [
    ("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("organisation", "organization"),
    ("favour", "favor"), ("judgement", "judgment"), ("merchantibility", "merchantability"), ("non-commercial", "noncommercial"),
    ("non-infringement", "noninfringement"), ("copyright owner", "copyright holder"), ("per cent", "percent"), ("&", " and "),
]
# Public licence texts and notices.
KNOWN = [
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("MIT", "notice", "SPDX-License-Identifier: MIT"),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "notice", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "notice", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MIT", "text", """MIT License
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", "text", """ISC License
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", "text", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", "text", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
]


def canonical_lines(text: Column) -> Column:
    """Canonical form of a text with its line breaks; copyright lines are empty."""
    lines = F.transform(F.split(F.lower(text), "\n"), lambda x: F.when(x.rlike(COPYRIGHT), F.lit("")).otherwise(x))
    plain = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), SPELLINGS, F.array_join(lines, "\n"))
    return F.regexp_replace(plain, PUNCTUATION, " ")


def canonical(text: Column) -> Column:
    return F.trim(F.regexp_replace(canonical_lines(text), "[ \n]+", " "))


def known_licenses(spark: SparkSession, known: list[tuple[str, str, str]] = KNOWN) -> DataFrame:
    rows = spark.createDataFrame(known, "license_id string, kind string, text string")
    return rows.select("license_id", "kind", F.sha2(canonical(F.col("text")), 256).alias("digest")).dropDuplicates(["digest"])


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row for each document (line_no 0) or line (from 1) that is a known licence: doc_id, line_no, license_id, kind, digest."""
    known = known_licenses(docs.sparkSession) if known is None else known
    if known.limit(KNOWN_ROWS + 1).count() <= KNOWN_ROWS:
        known = F.broadcast(known)
    lines = F.split(canonical_lines(F.col("text")), "\n")
    whole = F.trim(F.regexp_replace(F.array_join(lines, " "), " +", " "))
    units = docs.where("text is not null").select("doc_id", F.posexplode(F.concat(F.array(whole), lines)).alias("line_no", "unit"))
    # a text of one line is looked up once, as a whole
    single = F.when(F.col("line_no") > 0, F.trim("unit")).otherwise(F.col("unit"))
    units = units.select("doc_id", "line_no", single.alias("unit")).where("unit != ''")
    return units.select("doc_id", "line_no", F.sha2("unit", 256).alias("digest")).join(known, "digest").select("doc_id", "line_no", "license_id", "kind", "digest")
