"""Model replies: JSON out of prose, fences and cut-off output.

Clean JSON could be read by ``from_json``; these take what is left of a reply
that isn't, over Arrow batches, a reply at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

_FENCE = re.compile(r"\A```[A-Za-z]*\s*|\s*```\Z")
_TOKEN = re.compile(r'"(?:\\.|[^"\\])*(?:"|\Z)|[{}]', re.S)
_SAID = {
    "kind": re.compile(r"\b(?:kind|type)\b[*`_: ]*([A-Za-z_]+)", re.I),
    "keep": re.compile(r"\bkeep\b[*`_: ]*(true|false)\b", re.I),
    "reasoning": re.compile(r"\breasoning\b[*`_]*:[*`_ ]*(.*?)(?=\s*[*`_]*(?:caption|description)\b[*`_]*:|\Z)", re.I | re.S),
    "caption": re.compile(r"\b(?:caption|description)\b[*`_]*:[*`_ ]*(.*?)(?=\s*[*`_]*reasoning\b[*`_]*:|\Z)", re.I | re.S),
}


def unfenced(text: str | None) -> str:
    return _FENCE.sub("", (text or "").strip()).strip()


def _loads(text: str):  # noqa: ANN202
    try:
        return json.loads(text)
    except ValueError:
        return None


def balanced(text: str) -> Iterator[str]:
    """Outermost ``{…}`` in order; braces in strings don't count."""
    depth = start = 0
    for m in _TOKEN.finditer(text):
        if m[0] == "{":
            start = start if depth else m.start()
            depth += 1
        elif m[0] == "}" and depth:
            depth -= 1
            if not depth:
                yield text[start : m.end()]


def array_of(text: str | None) -> list | None:
    """The array of a reply; of a cut-off one its whole objects; else None."""
    plain = unfenced(text)
    for part in (plain, plain[plain.find("[") : plain.rfind("]") + 1]):
        if isinstance(found := _loads(part), list):
            return found
    decoder, out, at = json.JSONDecoder(), [], plain.find("{")
    while at >= 0:
        try:
            item, at = decoder.raw_decode(plain, at)
            out.append(item)
        except ValueError:
            at += 1
        at = plain.find("{", at)
    return out or None


def object_of(text: str | None):  # noqa: ANN201
    """The JSON of a reply: all of it, or what its ``Key: value`` lines say, or
    it with the braces it lacks, or its last whole object; else None."""
    plain = unfenced(text)
    if (found := _loads(plain)) is not None:
        return found
    if "**" in plain or re.search(r"(?:caption|keep|description):", plain, re.I):
        said = {k: m[1].strip() for k, p in _SAID.items() if (m := p.search(plain))}
        if said.keys() & {"kind", "keep", "caption"}:
            if "kind" in said:
                said["kind"] = said["kind"].lower()
            return said | ({"keep": said["keep"].lower() == "true"} if "keep" in said else {})
    if ":" in plain and not plain.startswith("{") and not plain.endswith("}") and (found := _loads("{" + plain + "}")) is not None:
        return found
    return next((found for part in reversed(list(balanced(text or ""))) if (found := _loads(part)) is not None), None)


def regions_of(text: str | None) -> list[dict]:
    """type and text of the blocks of a reply: its array, its ``blocks``, its
    whole objects where it was cut off, or all of it if it isn't JSON."""
    found = object_of(text)
    items = found if isinstance(found, list) else found.get("blocks") if isinstance(found, dict) else None
    told = lambda xs: [{"type": str(x.get("type") or "text"), "text": str(x["text"])} for x in xs if isinstance(x, dict) and x.get("text")]
    out = told(items) if isinstance(items, list) else []
    out = out or told(_loads(part) for part in balanced(text or ""))
    plain = unfenced(text)
    return out or ([{"type": "text", "text": plain}] if plain and plain[0] not in "[{" else [])


def content_of(text: str | None) -> str | None:
    """A page's text out of ``[{"content": …}]``, ``{"content": …}`` or ``["…"]``."""
    found = object_of(text)
    first = found[0] if isinstance(found, list) and found else found
    if isinstance(first, dict):
        return first.get("content") or text
    return first if isinstance(found, list) and isinstance(first, str) and first.strip() else text


def _said(value) -> str | None:  # noqa: ANN001
    return None if value is None else json.dumps(value, ensure_ascii=False, sort_keys=True)


@F.pandas_udf(ArrayType(StringType()))
def json_array(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if (x := array_of(t)) is None else [_said(i) for i in x])


@F.pandas_udf(StringType())
def json_object(text: pd.Series) -> pd.Series:
    return text.map(lambda t: _said(object_of(t)))


@F.pandas_udf(ArrayType(StructType().add("type", StringType()).add("text", StringType())))
def region_blocks(text: pd.Series) -> pd.Series:
    return text.map(regions_of)


@F.pandas_udf(StringType())
def unwrapped(text: pd.Series) -> pd.Series:
    return text.map(content_of)


def redacted(value, bad: re.Pattern, mask: str, depth: int = 8):  # noqa: ANN001, ANN201
    """A nested value with every string, keys too, that ``bad`` finds replaced."""
    if isinstance(value, str):
        return mask if bad.search(value) else value
    if depth > 0 and isinstance(value, dict):
        return {redacted(k, bad, mask, depth - 1): redacted(v, bad, mask, depth - 1) for k, v in value.items()}
    if depth > 0 and isinstance(value, list):
        return [redacted(v, bad, mask, depth - 1) for v in value]
    return value


def scan_json(pattern: str, mask: str = "[CONTENT REDACTED: injection detected]", depth: int = 8):  # noqa: ANN201
    """An Arrow function of a JSON column: the same JSON, injected strings of any depth replaced."""
    bad = re.compile(pattern, re.I)

    @F.pandas_udf(StringType())
    def scan(text: pd.Series) -> pd.Series:
        return text.map(lambda t: t if (x := _loads(t or "")) is None else json.dumps(redacted(x, bad, mask, depth), ensure_ascii=False))

    return scan


def classification(reply, known: list[str]):  # noqa: ANN001, ANN201
    """(doc_type, confidence, source) of a reply: its JSON, else what its prose
    names (with a confidence it states, in per cent or not), else the default."""
    from .text import coerce_type

    body = F.regexp_extract(F.coalesce(reply, F.lit("")), "(?s)\\{.*\\}", 0)
    parsed = F.from_json(F.nullif(body, F.lit("")), "document_type string, confidence double, _corrupt_record string")
    clean = parsed["_corrupt_record"].isNull() & parsed["document_type"].isNotNull()
    named = coerce_type(reply, known)
    stated = F.regexp_extract(F.coalesce(reply, F.lit("")), "(?i)confidence[^0-9]*([0-9]+(?:\\.[0-9]+)?)", 1).try_cast("double")
    share = F.when(stated > 1, stated / 100).otherwise(stated)
    told = lambda kind, sure, source: F.struct(kind.alias("doc_type"), sure.alias("confidence"), F.lit(source).alias("source"))
    return (
        F.when(clean, told(coerce_type(parsed["document_type"], known), F.coalesce(parsed["confidence"], F.lit(0.0)), "json"))
        .when(~named.isin("report", "unknown") & named.isin(known), told(named, F.coalesce(share, F.lit(0.85)), "prose"))
        .otherwise(told(F.lit("report"), F.lit(0.3), "default"))
    )


def caption(reply):  # noqa: ANN001, ANN201
    """(text, kind, confidence, failed) of a captioning reply: its description with
    its entities behind; the reply itself where it holds no JSON."""
    found = json_object(reply)
    get = lambda k: F.get_json_object(found, f"$.{k}")
    said = F.coalesce(F.nullif(F.trim(get("description")), F.lit("")), F.trim(get("caption")), F.lit(""))
    entities = F.from_json(get("entities"), "array<string>")
    text = F.when(F.size(entities) > 0, F.concat(said, F.lit("\n\nEntities: "), F.array_join(entities, ", "))).otherwise(said)
    failed = found.isNull()
    return F.struct(
        F.when(failed, F.trim(F.coalesce(reply, F.lit("")))).otherwise(text).alias("text"),
        F.when(failed, "other").otherwise(F.coalesce(get("type"), get("kind"), F.lit("other"))).alias("kind"),
        F.when(failed, 0.0).otherwise(F.coalesce(get("confidence").try_cast("double"), F.lit(0.95))).alias("confidence"),
        failed.alias("failed"),
    )


def planned(reply, question, most: int = 4):  # noqa: ANN001, ANN201
    """The sub-questions of a planner's reply (an array of strings), at most
    ``most``, the question itself among them; only it where the reply has none."""
    from ..operators.windows import with_verbatim

    subs = F.transform(F.filter(json_array(reply), lambda x: x.startswith('"')), lambda x: F.from_json(F.concat(F.lit('{"q":'), x, F.lit("}")), "q string")["q"])
    some = F.slice(F.coalesce(subs, F.array().cast("array<string>")), 1, most - 1)
    return with_verbatim(some, question)


# Characters of a tool's output that a conversation keeps
KEPT_CHARS = {"list_documents": 15000, "get_page_context": 25000}


def compacted(tool, content, default: int = 2000):  # noqa: ANN001, ANN201
    """A tool's output for a conversation: an answer (always of a search, of others
    when they are long) with a line for each citation, else a cut text."""
    limit = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in KEPT_CHARS.items() for x in kv)), tool), F.lit(default))
    found = F.from_json(content, "answer string, citations array<struct<filename:string,page:long,document_id:string>>")
    place = lambda c: F.coalesce(F.concat(F.lit(" (page "), c["page"].cast("string"), F.lit(")")), F.lit(""))
    owner = lambda c: F.coalesce(F.concat(F.lit(" [id: "), c["document_id"], F.lit("]")), F.lit(""))
    cited = F.transform(found["citations"], lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] = "), F.coalesce(c["filename"], F.lit("unknown")), place(c), owner(c)))
    said = F.concat_ws("\n", found["answer"], F.array_join(F.when(F.size(cited) > 0, cited), "\n"))
    short = (F.length(content) <= limit) & (tool != "search_documents")
    return F.when(short, content).when(found["answer"].isNotNull(), said).otherwise(F.substring(content, F.lit(1), limit))


def aligned(inputs, results):  # noqa: ANN001, ANN201
    """(input, result) by position; inputs that a short reply didn't reach have
    no result, and results beyond the inputs are left out."""
    return F.transform(inputs, lambda x, i: F.struct(x.alias("input"), F.get(results, i).alias("result")))
