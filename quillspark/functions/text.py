"""Text expressions: tokenisers, trims, estimates, guards; built-in functions only, all inside codegen or HOFs.

Every function takes and gives Columns; null in, null out, unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Full-width ASCII (U+FF01 to U+FF5E, and the ideographic space) folds to ASCII.
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "

#: Scripts written without spaces; their runs are cut into bigrams.
CJK = r"぀-ヿ㐀-䶿一-鿿가-힯"


def folded(text: Column) -> Column:
    return F.lower(F.translate(text, WIDE, NARROW))


def tokens(text: Column) -> Column:
    """Runs of letters and digits, folded and lower-cased; everything else separates."""
    return F.filter(F.split(folded(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def bigram_tokens(text: Column) -> Column:
    """As ``tokens``, but runs of CJK give their overlapping bigrams (a single character: itself)."""
    runs = F.regexp_extract_all(folded(text), F.lit(rf"[{CJK}]+|[\p{{L}}\p{{N}}&&[^{CJK}]]+"), 0)

    def cut(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(run.rlike(f"^[{CJK}]"), pairs).otherwise(F.array(run))

    return F.flatten(F.transform(runs, cut))


def query_tokens(text: Column, stopwords: list[str]) -> Column:
    """Tokens without stopwords, repeats kept; all tokens where nothing else is left."""
    own = tokens(text)
    kept = F.filter(own, lambda x: ~x.isin(stopwords)) if stopwords else own
    return F.when(F.size(kept) == 0, own).otherwise(kept)


def token_estimate(text: Column) -> Column:
    """Wide characters one each, the others four to a token, rounded up."""
    wide = F.length(F.regexp_replace(text, rf"[^{CJK}　-〿＀-￯]", ""))
    return wide + F.ceil((F.length(text) - wide) / 4)


def trimmed_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\p{P}\p{Z}\p{S}]+|[\p{P}\p{Z}\p{S}]+$", "")


def citation_ids(text: Column) -> Column:
    """Ids of well-formed citations ``[#a, #b]``, in order of appearance, repeats kept."""
    groups = F.regexp_extract_all(text, F.lit(r"\[(#[A-Za-z0-9_.:-]+(?:,\s*#[A-Za-z0-9_.:-]+)*)\]"), 1)
    return F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, r",\s*"), lambda x: F.substring(x, F.lit(2), F.length(x)))))


def without_citations(text: Column) -> Column:
    return F.regexp_replace(text, r"\s*\[#[A-Za-z0-9_.:-]+(?:,\s*#[A-Za-z0-9_.:-]+)*\]", "")


def template_pattern(template: str) -> str:
    """A regex for the lines that a template makes: ``{n}`` digits, ``{word}`` a word, ``{text}`` up to 200 characters."""
    import re

    bounded = {"n": r"[0-9]{1,9}", "word": r"[^\s]{1,40}", "text": r"[^\n]{1,200}"}
    parts = re.split(r"\{(\w+)\}", template)
    return "".join(re.escape(p) if i % 2 == 0 else bounded[p] for i, p in enumerate(parts))


def cut_at_leak(text: Column, templates: list[str]) -> Column:
    """The text up to the first line that has the shape of one of the templates."""
    shape = "|".join(template_pattern(x) for x in templates)
    at = F.regexp_instr(text, F.lit(rf"(?m)^(?:{shape})$"))
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)


def reply_verdict(text: Column, tools: list[str], start: list[str], anywhere: list[str], whole: list[str]) -> Column:
    """Why a finished reply is unfit: empty, json, wrap-up json, tool call, boilerplate; else fine. Null counts as empty."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))
    plain = F.lower(F.regexp_replace(t, r"\s+", " "))
    unfenced = F.regexp_replace(t, r"^```[A-Za-z]*\s*|\s*```$", "")
    opens = t.startswith("```") | t.startswith("{") | t.startswith("[{")
    nested = F.try_parse_json(unfenced).isNotNull() & unfenced.rlike(r"^[\[{]")
    call = F.lit(False)
    for name in tools:
        call = call | F.contains(t, F.lit(f"{name}(")) | F.contains(t, F.lit(f'"name": "{name}"')) | F.contains(t, F.lit(f'"name":"{name}"'))
    wrap = F.contains(t, F.lit('"facts"')) & (opens | F.contains(t, F.lit('"summary"')) | F.contains(t, F.lit('"hurt"')))
    stock = F.lit(False)
    for rule in start:
        stock = stock | plain.startswith(rule.lower())
    for rule in anywhere:
        stock = stock | F.contains(plain, F.lit(rule.lower()))
    for rule in whole:
        stock = stock | (trimmed_punctuation(plain) == rule.lower())
    return (
        F.when(~t.rlike(r"[\p{L}\p{N}]"), "empty").when(opens & nested, "json").when(wrap, "wrap-up json").when(call, "tool call").when(stock, "boilerplate").otherwise("fine")
    )


def clipped(text: Column, n: int) -> Column:
    """Control characters become spaces, then the first n characters."""
    return F.substring(F.regexp_replace(text, r"\p{Cntrl}", " "), 1, n)


def reworded(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The first rule whose pattern matches rewrites the text; without a match it stays."""
    out = None
    for pattern, to in rules:
        hit, made = text.rlike(pattern), F.regexp_replace(text, pattern, to)
        out = F.when(hit, made) if out is None else out.when(hit, made)
    return text if out is None else out.otherwise(text)


def crumbs(path: Column, dropped: list[str]) -> Column:
    """Path segments without the dropped ones and without immediate repeats."""
    own = F.filter(path, lambda x: ~x.isin(dropped)) if dropped else path
    return F.aggregate(own, F.array().cast("array<string>"), lambda acc, x: F.when(F.element_at(F.concat(F.array(F.lit(None).cast("string")), acc), -1).eqNullSafe(x), acc).otherwise(F.concat(acc, F.array(x))))


def repeats_a_segment(path: Column) -> Column:
    return F.size(F.array_distinct(path)) < F.size(path)


def page_url(pattern: str, page: Column) -> Column:
    """``{page}`` in the pattern stands for the page with underscores."""
    head, _, tail = pattern.partition("{page}")
    return F.concat(F.lit(head), F.replace(page, F.lit(" "), F.lit("_")), F.lit(tail))


def shape_of(template: Column, shapes: dict[str, str]) -> Column:
    """A template's shape, or the template itself."""
    out = None
    for k, v in shapes.items():
        out = F.when(template == k, v) if out is None else out.when(template == k, v)
    return template if out is None else out.otherwise(template)


def speaker_lines(text: Column) -> Column:
    """Lines ``Speaker: words`` with the line before them, as an array of structs."""
    lines = F.split(text, "\n")
    made = F.transform(lines, lambda x, i: F.struct(F.regexp_extract(x, r"^([^:\n]{1,40}): (.+)$", 1).alias("speaker"), F.regexp_extract(x, r"^([^:\n]{1,40}): (.+)$", 2).alias("words"), F.when(i > 0, F.get(lines, i - 1)).alias("before")))
    return F.filter(made, lambda s: s["speaker"] != "")


def character_bigrams(text: Column, plain: Callable[[Column], Column] | None = None) -> Column:
    """Distinct bigrams of the text made plain (by default letters and digits, case-folded); none below two characters, null of null."""
    own = (plain or normalised)(text)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(own) - 1, F.lit(1))), lambda i: F.substring(own, i, F.lit(2))))
    return F.when(F.length(own) >= 2, grams).when(own.isNotNull(), F.array().cast("array<string>"))


def normalised(text: Column) -> Column:
    """Letters and digits only, case-folded."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def set_similarity(a: Column, b: Column) -> Column:
    """100 * |a and b| div |a or b| of two arrays of distinct values; null counts as empty, and of two empty ones it is 0."""
    x, y = (F.coalesce(v, F.array().cast("array<string>")) for v in (a, b))
    both = F.size(F.array_intersect(x, y))
    return F.floor(100 * both / F.greatest(F.size(x) + F.size(y) - both, F.lit(1))).cast("long")


def bigram_similarity(a: Column, b: Column) -> Column:
    """100 * |A and B| div |A or B| of the two bigram sets; null has none."""
    return set_similarity(character_bigrams(a), character_bigrams(b))


def similar_names(df: DataFrame, group: str, name: str) -> DataFrame:
    """``_group, _x, _y, similar`` of each two distinct names of a group, in both orders and of each with itself."""
    names = df.select(F.col(group).alias("_group"), F.col(name).alias("_x")).distinct()
    others = names.withColumnRenamed("_x", "_y")
    return names.join(others, "_group").withColumn("similar", bigram_similarity(F.col("_x"), F.col("_y")))


def signature(*parts: Column) -> Column:
    """A content id: the first 16 hex digits of the SHA-256 of the parts joined by 0x1f; nulls count as empty."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16)
