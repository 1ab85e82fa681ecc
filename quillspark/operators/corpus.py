"""From raw pages and turns to records and retrieval units.

Regular cleaning is built-in expressions; what nests (tables, sections with a heading stack) or folds in
order (splitting, turn-aligned cuts) runs as Arrow-batched Python per page or per scene."""

from __future__ import annotations

import re
from dataclasses import dataclass
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import signature
from . import relational as R

# Limits of the corpus rules.
MIN_VISIBLE, ALIAS_MAX_CHARS, WHOLE_WORD_MAX = 200, 25, 4
MIN_SECTION, LEAD = 30, "lead"

_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def without_comments(text: Column) -> Column:
    """Closed comments go, and an unterminated one to the end."""
    return F.regexp_replace(text, r"(?s)<!--.*?(?:-->|\z)", "")


def without_blocks(text: Column, names: tuple[str, ...] = ("script", "style", "nav")) -> Column:
    for name in names:
        text = F.regexp_replace(text, rf"(?si)<{name}\b[^>]*>.*?</{name}\s*>", "")
    return text


def flattened(text: Column) -> Column:
    """Visible text: comments, dropped blocks, tags, entities, white space, in this order."""
    out = without_blocks(without_comments(text))
    out = F.regexp_replace(out, r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for name, char in _ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t\r\f]+", " "), r" ?\n[ \n]*", "\n"))


def headings(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?si)<h[1-6][^>]*>(.*?)</h[1-6]>"), 1)


def tab_panes(text: Column) -> Column:
    """Panes ``|-|name=body`` of a tabber, as structs."""
    names = F.regexp_extract_all(text, F.lit(r"(?s)\|-\|\s*([^=|]+?)\s*=(.*?)(?=\|-\||\z)"), 1)
    bodies = F.regexp_extract_all(text, F.lit(r"(?s)\|-\|\s*([^=|]+?)\s*=(.*?)(?=\|-\||\z)"), 2)
    return F.arrays_zip(names.alias("name"), bodies.alias("body"))


def definition_lists(text: Column) -> Column:
    """``term: a, b`` for each definition list."""
    out = F.regexp_replace(text, r"(?is)</dd>\s*<dd\b[^>]*>", ", ")
    out = F.regexp_replace(out, r"(?is)</dt>\s*<dd\b[^>]*>", ": ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?is)</d[dl]>\s*<dt\b[^>]*>", "\n"), r"(?i)</?d[ltd]\b[^>]*>", ""))


def visible_letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


# ---- nested structures ---------------------------------------------------------------------------------


def strip_tables(text: str) -> str:
    """The text without tables, nested ones included; an unclosed table runs to the end."""
    out, depth, at = [], 0, 0
    for m in re.finditer(r"(?i)<table\b[^>]*>|</table\s*>", text):
        if depth == 0:
            out.append(text[at : m.start()])
        depth = depth + 1 if m[0][1] != "/" else max(0, depth - 1)
        at = m.end()
    if depth == 0:
        out.append(text[at:])
    return "".join(out)


_TABLE_MARK = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(/?)(table|tr|t[dh])\b([^>]*)>|<[^>]*>")
_SPAN = re.compile(r"(?i)\b(row|col)span\s*=\s*[\"']?(\d{1,3})")


@dataclass
class Table:
    """A table as the grid that a browser shows: (text, whether a header cell) of each place that a cell covers.

    within: the number of the table around it, if any; its text is no part of that table's cells."""

    within: int | None
    grid: list[list[tuple[str, bool]]]

    def header_rows(self) -> int:
        """How many rows at the top hold header cells only."""
        full = [bool(row) and all(header for _, header in row) for row in self.grid]
        return full.index(False) if False in full else len(full)

    def find_header(self, *names: str) -> int | None:
        """The first row with header cells among which every name stands in one; titles above it don't matter."""
        for n, row in enumerate(self.grid):
            cells = [text for text, header in row if header]
            if cells and all(any(name in text for text in cells) for name in names):
                return n
        return None


class _Open:
    """A table being read: cells that have begun, and what spans down from rows above."""

    def __init__(self, number: int):
        self.number, self.row, self.cell = number, -1, None
        self.rows: list[list[tuple[str, bool, int, int]]] = []

    def begin_row(self) -> None:
        self.end_cell()
        self.rows.append([])

    def begin_cell(self, header: bool, attributes: str) -> None:
        self.end_cell()
        if not self.rows:
            self.rows.append([])
        span = {k.lower(): max(1, int(v)) for k, v in _SPAN.findall(attributes)}
        self.cell = ([], header, span.get("row", 1), span.get("col", 1))

    def end_cell(self) -> None:
        if self.cell:
            parts, *rest = self.cell
            self.rows[-1].append(("".join(parts).strip(), *rest))
            self.cell = None

    def grid(self) -> list[list[tuple[str, bool]]]:
        self.end_cell()
        taken: dict[tuple[int, int], tuple[str, bool]] = {}
        for r, row in enumerate(x for x in self.rows if x):
            c = 0
            for text, header, down, across in row:
                while (r, c) in taken:
                    c += 1
                for dr in range(down):
                    for dc in range(across):
                        taken.setdefault((r + dr, c + dc), (text, header))
                c += across
        rows = 1 + max((r for r, _ in taken), default=-1)
        return [[taken.get((r, c), ("", False)) for c in range(1 + max((k for q, k in taken if q == r), default=-1))] for r in range(rows)]


def tables_of(text: str) -> list[Table]:
    """All tables in the order in which they begin, nested ones too; read with a stack, as they nest.

    A cell ends where the next cell, row or end of its own table comes, whether it is closed or not; a table that isn't
    closed ends with the text. Comments and other tags are left out of texts; rows without cells are left out."""
    out: list[Table] = []
    open_: list[_Open] = []

    def close() -> None:
        done = open_.pop()
        out[done.number].grid = done.grid()

    at = 0
    for m in [*_TABLE_MARK.finditer(text), None]:
        words = text[at : m.start() if m else len(text)]
        if open_ and open_[-1].cell:
            open_[-1].cell[0].append(words)
        if m is None:
            break
        at = m.end()
        end, tag = m[1], (m[2] or "").lower()
        if tag == "table":
            if not end:
                out.append(Table(open_[-1].number if open_ else None, []))
                open_.append(_Open(len(out) - 1))
            elif open_:
                close()
        elif tag and open_:
            if tag == "tr":
                open_[-1].end_cell() if end else open_[-1].begin_row()
            elif end:
                open_[-1].end_cell()
            else:
                open_[-1].begin_cell(tag == "th", m[3])
    while open_:
        close()
    return out


def table_grid(text: str) -> list[list[str]]:
    """The first table's texts with rowspan and colspan expanded."""
    found = tables_of(text)
    return [[cell for cell, _ in row] for row in found[0].grid] if found else []


_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_HEADING = re.compile(r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1\s*>")


def _plain(markup: str) -> str:
    return " ".join(re.sub(r"<[^>]*>", " ", markup).split())


def split_sections(text: str, drop: tuple[str, ...] = (), least: int = MIN_SECTION, lead: str = LEAD) -> list[tuple[list[str], str, int]]:
    """(heading path, body, offset) of each section whose body has ``least`` characters.

    Comments go first, so a heading in one is none; offsets count in the text without them. What stands before
    the first heading is the section ``lead`` (without any heading: one section with an empty path). A
    heading of level n stands below the n - 1 outermost headings before it. Sections under a dropped heading go."""
    text = _COMMENT.sub("", text)
    marks = list(_HEADING.finditer(text))
    bounds = [0, *(m.end() for m in marks)]
    ends = [*(m.start() for m in marks), len(text)]
    path: list[str] = []
    out = []
    for n, (start, end) in enumerate(zip(bounds, ends, strict=True)):
        if n:
            del path[int(marks[n - 1][1]) - 1 :]
            path.append(_plain(marks[n - 1][2]))
        body = _plain(text[start:end])
        if len(body) >= least and not set(path) & set(drop):
            out.append((list(path) if n or not marks else [lead], body, marks[n - 1].start() if n else 0))
    return out


def split_text(text: str, limit: int, breaks: tuple[str, ...] = ("\n", ". ", " ")) -> list[str]:
    """Pieces of at most ``limit`` characters: cut after the last break of the first kind that lies past a third of
    the limit, else hard. Pieces have no outer white space; a text within the limit stays as it is."""
    if len(text) <= limit:
        return [text] if text else []
    out, start = [], 0
    while len(text) - start > limit:
        found = ((text.rfind(x, start, start + limit), x) for x in breaks)
        end = next((p + len(x) for p, x in found if p - start > limit // 3), start + limit)
        out.append(text[start:end].strip())
        start = end + len(text[end:]) - len(text[end:].lstrip()) if text[end : end + 1].isspace() else end
    return [x for x in [*out, text[start:]] if x]


def page_sections(pages: DataFrame, key: str, text: str, drop: tuple[str, ...] = (), least: int = MIN_SECTION) -> DataFrame:
    """``key, seq, path, body, at``: records of each page, by an Arrow-batched parser."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, n, *x) for k, t in zip(frame[key], frame[text], strict=True) for n, x in enumerate(split_sections(strip_tables(_COMMENT.sub("", t or "")), drop, least))]
            yield pd.DataFrame(rows, columns=[key, "seq", "path", "body", "at"])

    return pages.select(key, text).mapInPandas(parse, f"{key} {pages.schema[key].dataType.simpleString()}, seq int, path array<string>, body string, at int")


def page_records(pages: DataFrame, rules: DataFrame, title: str, text: str, parsers: dict[str, Callable[[str], tuple[list[tuple[str, str]], list[str]]]], bare: tuple[str, ...] = ()) -> DataFrame:
    """Records of each page by the parser of its route: the page's key columns, ``route, kind, seq, value``.

    A parser gives (kind, value) records and warnings. Warnings are rows of kind ``warning``; a page without
    records is a row of kind ``empty``, or ``expected empty`` on a route in ``bare``; one without a route or a
    parser is ``unrouted``. rules: ``route, pattern``."""
    keys = [c for c in pages.columns if c != text]
    own = pages.select(*keys, F.coalesce(text, F.lit("")).alias("_text"))
    found = routed(own, rules, title)
    names = [c for c in keys]
    unrouted = own.join(found.select(*names), names, "left_anti").withColumn("route", F.lit(None).cast("string"))
    every = found.select(*names, "route", "_text").unionByName(unrouted.select(*names, "route", "_text"))

    @F.pandas_udf("array<struct<kind:string,value:string>>")
    def parse(routes: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for route, x in zip(routes, texts, strict=True):
            if route not in parsers:
                out.append([("unrouted", None)])
                continue
            records, warnings = parsers[route](x)
            empty = [] if records else [("expected empty" if route in bare else "empty", None)]
            out.append([*records, *empty, *(("warning", w) for w in warnings)])
        return pd.Series([[{"kind": k, "value": v} for k, v in rows] for rows in out])

    return every.select(*names, "route", F.posexplode(parse("route", "_text")).alias("seq", "x")).select(*names, "route", "x.kind", "seq", "x.value")


def pieces(units: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """``key, piece, text``: units split to the limit."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t or "", limit))

    return units.select(key, F.posexplode(cut(F.col(text))).alias("piece", "text"))


def dialogue_units(lines: DataFrame, target: int = 600, most: int = 4) -> DataFrame:
    """``scene, unit, from, to, speakers, text``: neighbouring lines up to a target size, cut where the speaker changes.

    A unit closes when it has ``most`` lines or, from the target on, when the next line has another speaker.
    The cut depends on what has gathered since the last one, so each scene is folded in order."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        rows, held = [], []
        frame = frame.sort_values("seq", kind="stable")
        every = list(frame.itertuples(index=False))
        for i, line in enumerate(every):
            held.append(line)
            last = i + 1 == len(every)
            turn = not last and every[i + 1].speaker != line.speaker
            if last or len(held) >= most or (turn and sum(len(x.text or "") for x in held) >= target):
                speakers = list(dict.fromkeys(x.speaker for x in held))
                rows.append((line.scene, len(rows), int(held[0].seq), int(line.seq), ",".join(s or "" for s in speakers), "\n".join(f"{x.speaker}: {x.text or ''}" for x in held)))
                held = []
        return pd.DataFrame(rows, columns=["scene", "unit", "lo", "hi", "speakers", "text"])

    return lines.groupBy("scene").applyInPandas(fold, "scene long, unit long, lo long, hi long, speakers string, text string")


# ---- identity and aliases ------------------------------------------------------------------------------


def followed(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``node, target``: each node's end along edges ``node, next`` (one next a node); cycles end at their least node.

    Pointers double every round, so a chain of 2**rounds links ends; lineage is cut by checkpoint where the
    session has a folder for it."""
    spark = edges.sparkSession
    now = edges.select("node", F.col("next").alias("target")).dropDuplicates(["node"])
    least = now.select("node", F.least("node", "target").alias("least"))
    now = now.join(least, "node")
    for _ in range(rounds):
        ahead = now.select(F.col("node").alias("target"), F.col("target").alias("_t"), F.col("least").alias("_l"))
        step = now.join(ahead, "target", "left").select("node", F.coalesce("_t", "target").alias("target"), F.least("least", F.coalesce("_l", "target")).alias("least"))
        if spark.sparkContext.getCheckpointDir():
            step = step.checkpoint()
        moved = step.join(now.select("node", F.col("target").alias("_was")), "node").filter(F.col("target") != F.col("_was")).limit(1).count()
        now = step
        if not moved:
            break
    else:
        raise RuntimeError(f"pointers did not settle in {rounds} rounds")
    on_cycle = now.join(now.select(F.col("node").alias("target")).distinct(), "target", "left_semi").select("node", F.lit(True).alias("cyclic"))
    return now.join(on_cycle, "node", "left").select("node", F.when(F.col("cyclic"), F.col("least")).otherwise(F.col("target")).alias("target"))


def settled_targets(aliases: DataFrame) -> DataFrame:
    """Aliases whose target is itself an alias with exactly one target take that target."""
    unique = aliases.groupBy("alias").agg(F.countDistinct("target").alias("_n"), F.min("target").alias("_to")).filter("_n = 1")
    hop = unique.select(F.col("alias").alias("target"), F.col("_to").alias("settled"))
    return aliases.join(hop, "target", "left").select("alias", F.coalesce("settled", "target").alias("target"))


def term_aliases(terms: DataFrame, key: str, renderings: str) -> DataFrame:
    """Renderings split at slash or newline, trimmed, once each."""
    return terms.select(F.explode(F.split(renderings, r"[/\n]")).alias("alias"), F.col(key).alias("target")).withColumn("alias", F.trim("alias")).filter("alias <> ''").distinct()


def exact_terms(alias: Column, kind: Column) -> Column:
    """Short Latin terms only count as whole words."""
    return F.when(alias.rlike(r"^[\x20-\x7E]+$") & (F.length(alias) <= WHOLE_WORD_MAX), F.concat(kind, F.lit("_exact"))).otherwise(kind)


def resolved_identity(pages: DataFrame, declared: DataFrame, roster: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page, person) with declared forms on their canonical page, and violations: not in roster, chain, no canonical."""
    own = pages.join(declared, "page", "left").select("page", F.coalesce("canonical", "page").alias("person"))
    missing = declared.join(pages.select(F.col("page").alias("canonical")), "canonical", "left_anti").select("page", F.lit("no canonical").alias("problem"))
    chain = declared.join(declared.select(F.col("page").alias("canonical")), "canonical", "left_semi").select("page", F.lit("chain").alias("problem"))
    outside = own.join(roster.select(F.col("page").alias("person")), "person", "left_anti").select("page", F.lit("not in roster").alias("problem"))
    return own, missing.unionByName(chain).unionByName(outside)


def routed(pages: DataFrame, rules: DataFrame, title: str) -> DataFrame:
    """The most specific rule whose pattern matches the title: longest pattern, then its name. rules: ``route, pattern``."""
    hits = pages.join(R.small(rules), F.expr(f"{title} rlike pattern"))
    return R.first_per_group(hits, [c for c in pages.columns], [F.desc(F.length("pattern")), "route"]).drop("pattern")


# ---- speakers --------------------------------------------------------------------------------------------


def majority(lines: DataFrame, label: str, person: str, least: int = 10, share: float = 0.6) -> DataFrame:
    """label -> person where one person has at least ``least`` of the label's lines and ``share`` of them."""
    counts = lines.groupBy(label, person).agg(F.count("*").alias("n"))
    best = counts.withColumn("all", F.sum("n").over(Window.partitionBy(label)))
    top = R.first_per_group(best, [label], [F.desc("n"), person])
    return top.filter((F.col("n") >= least) & (F.col("n") >= share * F.col("all"))).select(label, person, "n", "all")


def owner_ladder(labels: DataFrame, label: str, *ladders: DataFrame) -> DataFrame:
    """The first ladder that names exactly one person for a label; ladders are ``label, person``."""
    out, names = labels.select(label).distinct(), []
    for n, ladder in enumerate(ladders):
        one = ladder.groupBy(label).agg(F.countDistinct("person").alias("_n"), F.min("person").alias(f"_p{n}")).filter("_n = 1").drop("_n")
        out = out.join(one, label, "left")
        names.append(f"_p{n}")
    return out.select(label, F.coalesce(*names).alias("person"))


# ---- roster and statistics -------------------------------------------------------------------------------


def roster_confidence(material: DataFrame, value: str) -> DataFrame:
    """confidence = m / (m + median) to four digits; the median is the upper one of all values."""
    median = R.values_at(material, [], value, {"_median": R.upper_place}).select("_median")
    return material.crossJoin(F.broadcast(median)).withColumn("confidence", F.round(F.col(value) / (F.col(value) + F.col("_median")), 4)).drop("_median")


def template_stats(units: DataFrame, template: str, chars: str) -> DataFrame:
    top = units.groupBy(template).agg(F.max(chars).alias("max"))
    return R.values_at(units, [template], chars, {"p50": R.floor_place(0.5), "p95": R.floor_place(0.95)}).join(top, template).select(template, "n", "p50", "p95", "max")


def fingerprint(units: DataFrame, key: str) -> DataFrame:
    """One digest of all ids, whatever their order: their number, and sums and exclusive ors of two hashes of each.

    Sums and ors don't depend on order, so parts combine before the shuffle and nothing is sorted or listed."""
    digest = F.md5(F.col(key).cast("string"))
    halves = [F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 16)]
    sums = units.select(halves[0].alias("a"), halves[1].alias("b")).agg(F.count("*").alias("n"), *[f(x).alias(f"{x}{i}") for i, f in enumerate((lambda x: F.sum(F.col(x).cast("decimal(38,0)")), F.bit_xor)) for x in "ab"])
    return sums.select(F.sha2(F.concat_ws(" ", "n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("a0", "b0", "a1", "b1")]), 256).alias("fingerprint"))


def facet_cards(forms: DataFrame, person: str, page: str, facets: str) -> DataFrame:
    """For each form but a person's first page: the facets that differ from the first page's."""
    first = R.first_per_group(forms, [person], [page]).select(person, F.col(page).alias("_first"), F.col(facets).alias("_base"))
    other = forms.join(first, person).filter(F.col(page) != F.col("_first"))
    differing = F.map_filter(facets, lambda k, v: ~v.eqNullSafe(F.element_at("_base", k)))
    return other.select(person, page, F.array_join(F.array_sort(F.map_keys(differing)), ",").alias("fields"))


def merged_order(orders: list[list[str]]) -> list[str]:
    """One order that agrees with each record's own order of keys where they agree with each other; first come first."""
    out: list[str] = []
    for order in orders:
        at = 0
        for key in order:
            if key in out:
                at = max(at, out.index(key) + 1)
            else:
                out.insert(at, key)
                at += 1
    return out


def content_ids(df: DataFrame, *parts: str) -> DataFrame:
    return df.withColumn("sig", signature(*[F.col(p) for p in parts]))
