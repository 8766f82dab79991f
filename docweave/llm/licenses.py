"""License scans by canonical digest lookup.

A whole text, and each of its paragraphs and lines, is normalised: lower case,
copyright lines and comment marks dropped, equivalent spellings made one, the
holder's name in the clauses that have a place for it made one, punctuation and
white space collapsed. Its SHA-256 is then joined with the
digests of known licences, normalised the same way. So a match is a whole
licence (or notice), never a likeness.

Null and empty texts match nothing. A document with the same licence more than
once has one row for it and each kind of unit; rows of one id count as one
document, those without an id as one too. Other columns, whatever their names,
are not read. Very long texts are cut into units like others and read whole; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import reduce
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings of the public license-matching guidelines
EQUIVALENT = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "catalogue": "catalog",
    "centre": "center",
    "copyright holder": "copyright owner",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "noncommercial": "non commercial",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "per cent": "percent",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sub license": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
    "https": "http",
}

# Licence texts and common notices
KNOWN = {
    "Apache-2.0 notice": ["Licensed under the Apache License, Version 2.0."],
    "GPL-3.0 notice": ["This work is licensed under the GNU General Public License, version 3."],
    "MIT notice": ["Released under the MIT License.", "Licensed under the MIT License."],
    "CC-BY-NC-4.0 notice": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-4.0 notice": ["Licensed under CC BY 4.0."],
    "BSD-3-Clause notice": ["Licensed under the BSD 3-Clause License."],
    "MIT": [
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
    ],
    "ISC": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
    ],
    "0BSD": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
    ],
    "BSD-2-Clause": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
    ],
    "BSD-3-Clause": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
    ],
    "Zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
    ],
}

# Title lines under which the texts above are published
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD Zero Clause License (0BSD)", "0BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License", "BSD License"],
    "Zlib": ["zlib License", "The zlib License", "zlib License (Zlib)", "The zlib/libpng License", "zlib"],
}
#: longer licences, whole, as published; they bring their own titles
LONG = ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0")


def published() -> dict[str, list[str]]:
    """KNOWN and LONG in the forms in which they are published: with a title or
    without, lists with numbers or bullets, Apache-2.0 with its appendix or without."""
    out = {name: list(texts) for name, texts in KNOWN.items()}
    for name, titles in TITLES.items():
        texts = out[name]
        texts += [re.sub("(?m)^[0-9][.] ", "* ", t) for t in texts if re.search("(?m)^[0-9][.] ", t)]
        texts += [t.replace("modify, and/or distribute", "modify, and distribute") for t in texts if name == "ISC"]
        out[name] = texts + [f"{title}\n\n{t}" for title in titles for t in texts]
    out |= {name: [resources.files(__package__).joinpath(f"license_texts/{name}.txt").read_text(encoding="utf-8")] for name in LONG}
    whole = out["Apache-2.0"][0]
    end = "END OF TERMS AND CONDITIONS"
    terms, appendix = whole.split(end)
    below = terms[terms.index("TERMS AND CONDITIONS FOR USE") :]
    out["Apache-2.0"] = [h + t for h in (terms, below) for t in (end + appendix, end, "")]
    out["Apache-2.0 notice"].append(appendix[appendix.index("Licensed under") :])
    return out


# what follows the word in running text, where a line happens to begin with it
_RUNNING = (
    "(?:notices?|holders?|owners?|ownership|licen[cs](?:e[sd]?|ors?|ing)|laws?|doctrines?|statements?|interests?|permissions?|treat(?:y|ies)|rights?|works?|materials?|protections?|protected|claims?|infringements?"
    "|status|conditions?|disclaimers?|patents?|trademarks?|terms|information|attributions?|marks?|legends?|registrations?|restrictions?|acts?|subject|grants?|resulting|related|applicable|relevant"
    "|and|or|on|in|of|to|for|is|as|are|an?|any|that|this|these|those|which|with|without|from|under|over|if|be|but|not|it|its|their|such|where|when|within|may|shall|can|must|will|would|has|have|does|at|than"
    "|the (?:software|works?|programs?|library|libraries|code|documentation|materials?|above|following|same|terms))"
)
_YEAR = "[\\[<{(]?[ \\t]*(?:[0-9]{4}|yyyy\\b|years?\\b)"
#: a notice's line (of lower-case text): the word with a sign, a year or a holder
_COPYRIGHT = (
    "(?m)^[^a-z0-9\\n]*(?:"
    f"copyrights?[ \\t:,]*(?:\\(c\\)|©|{_YEAR}|by\\b)"
    f"|\\(c\\)[ \\t]*(?:copyright\\b|{_YEAR})"
    "|©|all rights reserved"
    f"|copyright(?:[ \\t]+|[ \\t]*:[ \\t]*)(?!{_RUNNING}\\b|the[ \\t\\r]*$)[\\p{{L}}\\[<{{]"
    ")[^\\n]*$"
)
# clauses with a place for the holder's name
_HOLDERS = {
    "\\bneither the names? of .{1,120}? nor the names of (?:its|their|any) contributors\\b": "neither the name of the holder nor the names of its contributors",
    "\\bthis software is provided by .{1,120}? as is and any\\b": "this software is provided by the holder as is and any",
    "\\bin no event shall .{1,120}? be liable\\b": "in no event shall the holder be liable",
}


def canonical(text: Column) -> Column:
    """The normal form; texts that normalise equally count as equal."""
    out = F.regexp_replace(F.lower(text), _COPYRIGHT, " ")
    out = F.trim(F.regexp_replace(out, "[^\\p{L}\\p{N}]+", " "))
    spelled = "\\b(" + "|".join(sorted(EQUIVALENT, key=len, reverse=True)) + ")\\b"
    for clause, said in _HOLDERS.items():
        out = F.regexp_replace(out, clause, said)
    fixed = out
    for old, new in EQUIVALENT.items():
        fixed = F.regexp_replace(fixed, f"\\b{old}\\b", new)
    # most texts have no word of the list: one search instead of forty replacements
    return F.when(out.rlike(spelled), fixed).otherwise(out)


def known_licenses(spark: SparkSession, texts: dict[str, list[str]] | None = None) -> DataFrame:
    """license, digest, anchor: one row for each known text. The anchor is its
    longest word that no other spelling stands for, so every text of the same
    normal form has it too."""
    rows = [(name, t) for name, ts in (texts or published()).items() for t in ts]
    form = spark.createDataFrame(rows, "license string, text string").select("license", canonical(F.col("text")).alias("form"))
    respelled = sorted({w for v in EQUIVALENT.values() for w in v.split()})
    firm = F.filter(F.split("form", " "), lambda w: ~w.isin(*respelled))
    longest = F.array_max(F.transform(firm, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    return form.select("license", F.sha2(F.col("form").cast("binary"), 256).alias("digest"), longest.alias("anchor")).distinct()


#: anchors up to which each is looked for by itself; more are looked up word by word
ANCHORS = 64


def _may_match(text: Column, lookup: DataFrame, at_most: int) -> Column:
    """Whether a text has an anchor of some known one; true where one has none,
    and where there are more than ``at_most``, too many to hold in a plan."""
    if "anchor" not in lookup.columns:
        return F.lit(True)
    anchors = [r["anchor"] for r in lookup.select("anchor").distinct().limit(at_most + 1).collect()]
    if len(anchors) > at_most or None in anchors:
        return F.lit(True)
    low = F.lower(text)
    if len(anchors) > ANCHORS:
        return F.exists(F.split(low, "[^\\p{L}\\p{N}]+"), lambda w: w.isin(anchors))
    return reduce(lambda x, y: x | y, (F.contains(low, F.lit(a)) for a in anchors), F.lit(False))


#: known texts for which the digests are sent to every executor (about 100 bytes each)
BROADCAST_ROWS = 50_000


def scan(docs: DataFrame, *, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, unit (text, paragraph or line), n_units: one row for
    each licence and kind of unit of a document."""
    spark = docs.sparkSession
    lookup = known_licenses(spark) if known is None else known
    bounded = lookup.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    text = F.col("text")
    # a single line is a line, not also a paragraph or a text
    cut_to = lambda pattern: F.split(text, pattern)
    blocks = F.filter(cut_to("\\n[ \\t]*\\n\\s*"), lambda p: F.instr(p, "\n") > 0)
    units = F.concat(
        F.transform(cut_to("\\n"), lambda u: F.struct(F.lit("line").alias("unit"), u.alias("part"))),
        F.transform(blocks, lambda u: F.struct(F.lit("paragraph").alias("unit"), u.alias("part"))),
        F.when(F.instr(text, "\n") > 0, F.array(F.struct(F.lit("text").alias("unit"), text.alias("part")))).otherwise(
            F.expr("cast(array() as array<struct<unit:string,part:string>>)")
        ),
    )
    parts = docs.select(F.col(id_col).alias("doc_id"), text_col if text_col == "text" else F.col(text_col).alias("text"))
    likely = _may_match(text, lookup, BROADCAST_ROWS)
    parts = parts.where(text.isNotNull() & likely).select("doc_id", F.explode(units).alias("u")).where(_may_match(F.col("u.part"), lookup, BROADCAST_ROWS))
    digests = parts.select("doc_id", "u.unit", F.sha2(canonical(F.col("u.part")).cast("binary"), 256).alias("digest"))
    by_digest = lookup.select("digest", "license")
    found = digests.join(F.broadcast(by_digest) if bounded else by_digest, "digest")
    return found.groupBy("doc_id", "license", "unit").agg(F.count("*").alias("n_units"))
