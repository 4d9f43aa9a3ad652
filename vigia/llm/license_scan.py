"""Operator 2: licence texts found by the digest of their canonical form, in DataFrame functions alone."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigia.llm.common import table, text_or_empty

# Notices of well-known licences, by their identifiers.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>'),
    ("BSL-1.0", 'Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
]
# Titles that stand above a licence.
TITLES = {"MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License"], "0BSD": ["BSD Zero Clause License"], "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License"], "Zlib": ["zlib License"]}
# Lists may have other marks than numbers.
NOTICES += [(name, re.sub(r" [123]\. ", " ", text)) for name, text in NOTICES if re.search(r" [123]\. ", text)]
NOTICES += [(name, f"{title}\n{text}") for name, text in NOTICES if len(text) > 500 for title in TITLES.get(name, ())]
# Identifiers that a line may state.
IDENTIFIERS = "MIT ISC 0BSD Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 Zlib Unlicense MPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later EPL-2.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0".split()
NOTICES += [(name, f"SPDX-License-Identifier: {name}") for name in IDENTIFIERS]
# Spellings that count as one.
SPELLINGS = [("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("copyright holder", "copyright owner"), ("https", "http")]
# The lines of a text that only name a holder of rights: a copyright mark with a sign or a year after it, however long.
_YEAR = r"[<\[({]?((19|20)[0-9][0-9]|year|yyyy)"
COPYRIGHT_LINE = rf"(?i)^[^a-z0-9©]*(copyright[^a-z0-9©(]*(\(c\)|©|{_YEAR})|©|\(c\)[^a-z0-9]*(copyright|{_YEAR}))|^[^a-z0-9]*all rights reserved[^a-z0-9]*$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: More known digests than this are joined by a shuffle instead of a broadcast.
MAX_BROADCAST_DIGESTS = 100_000


def canonical(text: Column) -> Column:
    """Case, punctuation, white space and spellings made alike; letters outside ASCII stay as they are."""
    out = F.translate(text, UPPER, LOWER)
    out = F.trim(F.regexp_replace(out, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    for given, same in SPELLINGS:
        out = F.regexp_replace(out, given, same)
    return out


def digests(texts: DataFrame) -> DataFrame:
    """Of ``text`` (and any other columns) ``whole``, the digest of the text without copyright lines, and ``lines``, those of its distinct lines."""
    others = [c for c in texts.columns if c != "text"]
    kept = F.filter(F.split(text_or_empty("text"), "\n"), lambda x: ~x.rlike(COPYRIGHT_LINE))
    rows = texts.select(*others, F.array_remove(F.transform(kept, canonical), "").alias("clean"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select(*others, F.when(F.size("clean") > 0, digest(F.array_join("clean", " "))).alias("whole"), F.transform(F.array_distinct("clean"), digest).alias("lines"))


def known_digests(licenses: DataFrame) -> DataFrame:
    """``digest, license`` of a registry ``license, text``; texts that are alike in canonical form take the first name."""
    return digests(licenses.select("license", "text")).where("whole is not null").groupBy(F.col("whole").alias("digest")).agg(F.min("license").alias("license"))


def license_scan(documents: DataFrame, licenses: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Known licences of each text: as the whole text, and as one of its lines.

    Columns: ``key, text_license`` (null if the whole text is none), ``n_license_lines`` (distinct lines that are
    one) and ``line_licenses`` (their names in order, joined by commas; empty if none). Null and empty texts have
    none; rows with a null key and repeated rows each keep a row; an empty table gives none. Digests are looked up where the text is read;
    only those that are found, and numbers for the rows, are shuffled.
    """
    known = known_digests(licenses)
    known = F.broadcast(known) if licenses.count() <= MAX_BROADCAST_DIGESTS else known
    # A row is known by its key and its text, as keys may repeat.
    rows = documents.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    each = digests(rows).select("key", "h", "whole", F.explode(F.array_append("lines", F.lit(None))).alias("line"))
    looked = each.select("key", "h", F.coalesce("line", "whole").alias("digest"), F.col("line").isNull().alias("is_text"))
    found = looked.join(known, "digest").groupBy("key", "h").agg(
        F.max(F.when(F.col("is_text"), F.col("license"))).alias("text_license"),
        F.collect_set(F.when(~F.col("is_text"), F.col("digest"))).alias("lines"),
        F.collect_set(F.when(~F.col("is_text"), F.col("license"))).alias("names"),
    )
    a, b = rows.drop("text").alias("a"), found.alias("b")
    joined = a.join(b, F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.h") == F.col("b.h")), "left")
    n = F.when(F.col("b.lines").isNull(), F.lit(0)).otherwise(F.size("b.lines")).cast("long")
    return joined.select("a.key", "b.text_license", n.alias("n_license_lines"), F.coalesce(F.array_join(F.sort_array("b.names"), ","), F.lit("")).alias("line_licenses"))


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NOTICES, "license string, text string")


def registry_from_files(spark: SparkSession, path: str) -> DataFrame:
    """A registry of whole texts, one file each, that are called by their files' names without the suffix."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.txt|\.md)?$", 1).alias("license"), F.col("value").alias("text"))

def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"), registry(spark)).withColumnRenamed("key", "doc_id")


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    clean = f"trim(regexp_replace(translate(x, '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'))"
    for given, same in SPELLINGS:
        clean = f"replace({clean}, {quote(given)}, {quote(same)})"
    lines = lambda t: f"list_filter([{clean} FOR x IN string_split({t}, chr(10)) IF NOT regexp_matches(x, {quote(COPYRIGHT_LINE)})], lambda y: y <> '')"
    values = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in NOTICES)
    return f"""
WITH known AS (SELECT sha256(array_to_string(c, ' ')) AS digest, min(license) AS license FROM (SELECT license, {lines("t")} AS c FROM (VALUES {values}) AS v(license, t)) GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, {lines("coalesce(text, '')")} AS c FROM documents),
l AS (SELECT r, sha256(unnest(list_distinct(c))) AS digest FROM d),
f AS (SELECT r, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names FROM l JOIN known USING (digest) GROUP BY r)
SELECT doc_id, k.license AS text_license, coalesce(n, 0) AS n_license_lines, coalesce(names, '') AS line_licenses
FROM d LEFT JOIN f ON d.r = f.r LEFT JOIN known k ON len(c) > 0 AND k.digest = sha256(array_to_string(c, ' '))
"""


OP2_SQL = _sql()
