"""Text normalisation, fingerprints and parsers of SQL, model, DAG, CI and log text.

Every parser is a column expression over one cell, so a scan of texts needs no
Python worker and no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.constants import TEXT_SUFFIXES
from plumbline.functions.labels import blank_to_null

# All characters that count as white space in Unicode text, not only the ASCII ones.
SPACES = (
    r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)
NAME = r"[\w\-]+"
# Quoted text, and comments. Loops are possessive, so that a long text needs no stack.
QUOTED = r'"""(?s:.*?)"""|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|\'[^\'\\\n]*+(?:\\.[^\'\\\n]*+)*+\''
COMMENT = r"--[^\n]*+|/\*(?s:.*?)\*/"
# Stands behind the bracket that closes a type, while columns are split.
TYPE_END = "\u0001"
QUALIFIED = rf"`?(?:(?:{NAME})\.)?({NAME})\.({NAME})`?"
# Object kinds a definition can create, strongest first.
KINDS = ["materialized view", "view", "table", "procedure", "function"]


def normalize_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def normalize_sql(c: Column) -> Column:
    """SQL without comments, backticks, case and layout, for comparing meaning."""
    text = F.regexp_replace(c, "\r\n", "\n")
    text = F.regexp_replace(text, r"--[^\n]*", "")
    text = F.regexp_replace(text, r"(?s)/\*.*?\*/", "")
    text = F.replace(text, F.lit("`"), F.lit(""))
    text = F.regexp_replace(text, SPACES, " ")
    return F.lower(F.trim(text))


def strip_project(c: Column, project: Column) -> Column:
    """Drop the project part of names, quoted or bare, where it is the given project."""
    quoted_project = F.concat(F.lit(r"\Q"), project, F.lit(r"\E\."))
    pair = r"([A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+)"
    text = F.regexp_replace(c, F.concat(F.lit("`"), quoted_project, F.lit(pair + "`")), F.lit("$1"))
    return F.regexp_replace(text, F.concat(F.lit(r"\b"), quoted_project, F.lit(pair + r"\b")), F.lit("$1"))


def strip_comments(c: Column) -> Column:
    """Text without comments; what looks like one inside quotes stays."""
    return F.regexp_replace(c, rf"({QUOTED}|`[^`\n]*+`)|{COMMENT}", "$1")


def definition_body(c: Column) -> Column:
    """View text without its ``create … as`` head, so a file and a catalog body compare.

    The head ends at the first word ``as`` outside quotes and comments.
    """
    create = rf"\bcreate\s+(?:or\s+replace\s+)?(?:materialized\s+)?view\s+(?:if\s+not\s+exists\s+)?{QUALIFIED}"
    unit = rf"(?:{QUOTED}|(?!as\b)\w++|[^\w\"']|[\"'])"
    body = F.regexp_replace(strip_comments(c), rf"(?i)^(?s:.*?){create}{unit}*+as\b", "")
    return F.regexp_replace(body, r"[\s;]+$", "")


def ddl_target(c: Column) -> Column:
    """``struct(dataset, object, kind)`` of the strongest definition in a text.

    One pass collects the heads of all definitions in the text; the head whose
    kind ranks first wins, then the earliest. Kind is ``unknown`` without any.
    """
    kinds = "|".join(kind.replace(" ", r"\s+") for kind in KINDS)
    create = rf"create\s+(?:or\s+replace\s+)?(?:{kinds})\s+(?:if\s+not\s+exists\s+)?"
    heads = F.regexp_extract_all(c, F.lit(rf"(?i)((?:{create}|alter\s+table\s+){QUALIFIED})"), F.lit(1))

    def rank(head: Column) -> Column:
        chain = F.when(head.rlike(r"(?i)^alter"), F.lit(len(KINDS)))
        for position, kind in enumerate(KINDS):
            spelled = kind.replace(" ", r"\s+")
            chain = chain.when(head.rlike(rf"(?i)^create\s+(?:or\s+replace\s+)?{spelled}\s"), F.lit(position))
        return chain

    ranked = F.transform(heads, lambda h, i: F.struct(rank(h).alias("rank"), i.alias("at"), h.alias("head")))
    best = F.array_min(ranked)
    names = F.array(*[F.lit(kind.replace(" ", "_")) for kind in KINDS], F.lit("alter_table"))
    tail = rf"{QUALIFIED}$"
    return F.struct(
        F.regexp_extract(best["head"], tail, 1).alias("dataset"),
        F.regexp_extract(best["head"], tail, 2).alias("object"),
        F.coalesce(F.get(names, best["rank"]), F.lit("unknown")).alias("kind"),
    )


def _clean_type(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(c), r"\s*([,<>()])\s*", "$1"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(c: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Each element of an array combined with all before it, by steps of doubling width."""

    def widen(found: Column, k: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(found, lambda x, i: F.when(i >= step, combine(x, F.get(found, i - step))).otherwise(x))

    rounds = F.ceil(F.log2(F.greatest(F.size(c), F.lit(1)))).cast("int")
    return F.aggregate(F.sequence(F.lit(0), rounds), c, widen)


def _top_level_items(c: Column) -> Column:
    """Comma-separated items of ``c`` up to the parenthesis that closes them, whatever is nested in them.

    The text is cut behind each bracket and comma, depths are running sums over
    the pieces, and items are the pieces between commas at depth zero. The end
    of an outermost angle bracket is marked, so a type can be cut out later.
    ``closed`` is false when the text ends first.
    """
    zero, one = F.lit(0), F.lit(1)
    pieces = F.regexp_extract_all(c, F.lit(r"[^(),<>]*+[(),<>]|[^(),<>]++\z"), zero)

    def bends(s: Column, rise: str, fall: str, outside: Callable[[Column], Column]) -> Column:
        turn = lambda x, i: F.when(outside(i) & x.endswith(rise), one).when(outside(i) & x.endswith(fall), -one).otherwise(zero)
        return F.transform(s, turn)

    def with_rounds(p: Column) -> Column:
        return F.struct(p.alias("p"), _running(bends(p, "(", ")", lambda i: F.lit(True)), lambda x, y: x + y).alias("round"))

    def with_end(s: Column) -> Column:
        end = F.array_position(s["round"], -1).cast("int")
        size = F.when(end > 0, end).otherwise(F.size(s["p"]))
        return F.struct(F.slice(s["p"], one, size).alias("p"), F.slice(s["round"], one, size).alias("round"), end.alias("end"))

    def with_bends(s: Column) -> Column:
        bend = bends(s["p"], "<", ">", lambda i: F.get(s["round"], i) == 0)
        return F.struct(*[s[n].alias(n) for n in ("p", "round", "end")], _running(bend, lambda x, y: x + y).alias("sum"))

    def with_angles(s: Column) -> Column:
        least = _running(s["sum"], lambda x, y: F.least(x, y))  # a closing bracket without its opening one counts for nothing
        angle = F.zip_with(s["sum"], least, lambda x, low: x - F.least(zero, low))
        return F.struct(*[s[n].alias(n) for n in ("p", "round", "end")], angle.alias("angle"))

    def with_cuts(s: Column) -> Column:
        at = lambda name, i: F.get(s[name], i)
        ends_type = lambda x, i: x.endswith(">") & (at("round", i) == 0) & (at("angle", i) == 0) & (at("angle", i - 1) == 1)
        marked = F.transform(s["p"], lambda x, i: F.when(ends_type(x, i), F.concat(x, F.lit(TYPE_END))).otherwise(x))
        splits = lambda x, i: (x.endswith(",") & (at("round", i) == 0) & (at("angle", i) == 0)) | (i + 1 == s["end"])
        cuts = F.filter(F.transform(s["p"], lambda x, i: F.when(splits(x, i), i + 1)), lambda i: i.isNotNull())
        return F.struct(marked.alias("p"), cuts.alias("cuts"), (s["end"] > 0).alias("closed"))

    def items(s: Column) -> Column:
        before = lambda k: F.when(k > 0, F.get(s["cuts"], k - 1)).otherwise(zero)
        text = lambda i, n: F.array_join(F.slice(s["p"], i + 1, n), "")
        whole = F.transform(s["cuts"], lambda end, k: F.regexp_replace(text(before(k), end - before(k)), r".\z", ""))
        last = before(F.size(s["cuts"]))
        rest = F.when(s["closed"], F.array().cast("array<string>")).otherwise(F.array(text(last, F.size(s["p"]) - last)))
        return F.struct(F.concat(whole, rest).alias("items"), s["closed"].alias("closed"))

    out = pieces
    for step in (with_rounds, with_end, with_bends, with_angles, with_cuts, items):
        out = _once(out, step)
    return out


def _pairs(items: Column) -> Column:
    """(name, type) structs of items that begin with both, in text order; a name may occur again."""
    column = rf"^\s*`?({NAME})`?\s+(\w+(?:\s*<[^{TYPE_END}]*|\s*\([^()]*+\))?)"
    pairs = F.transform(
        items,
        lambda i: F.struct(F.regexp_extract(i, column, 1).alias("name"), _clean_type(F.regexp_extract(i, column, 2)).alias("type")),
    )
    return F.filter(pairs, lambda p: p["name"] != "")


def create_columns(c: Column) -> Column:
    """(name, type) structs of a CREATE TABLE body, split at top-level commas.

    Quoted strings and comments are blanked first, so brackets and commas in
    them count for nothing; brackets may nest to any depth. A body that never
    closes has no columns.
    """
    head = rf"(?i)create\s+(?:or\s+replace\s+)?table\s+(?:if\s+not\s+exists\s+)?{QUALIFIED}\s*\((?s:(.*))$"
    plain = F.regexp_replace(c, rf"{QUOTED}|{COMMENT}", " ")
    none = F.array().cast("array<struct<name:string,type:string>>")
    return _once(_top_level_items(F.regexp_extract(plain, head, 3)), lambda b: F.when(b["closed"], _pairs(b["items"])).otherwise(none))


def added_columns(c: Column) -> Column:
    """(name, type) structs of ALTER … ADD COLUMN clauses."""
    plain = F.regexp_replace(c, rf"{QUOTED}|{COMMENT}", " ")
    clauses = F.split(plain, r"(?i)\badd\s+column(?:\s+if\s+not\s+exists)?(?=[\s`])")
    first = F.transform(F.slice(clauses, 2, F.greatest(F.size(clauses) - 1, F.lit(0))), lambda x: F.get(_top_level_items(x)["items"], F.lit(0)))
    return _pairs(first)


def materialization(c: Column) -> Column:
    """Materialisation named in the first inline ``config(...)`` of a model."""
    config = F.regexp_extract(c, r"(?is)config\s*\((.*?)\)", 1)
    value = F.regexp_extract(config, r"""(?i)materialized\s*=\s*['"]([^'"]+)['"]""", 1)
    return blank_to_null(F.lower(F.trim(value)))


def dag_ids(c: Column) -> Column:
    """Sorted distinct DAG ids, from generated globals and from arguments."""
    generated = F.regexp_extract_all(c, F.lit(r'globals\(\)\["([^"]+)"\]'), F.lit(1))
    argument = F.regexp_extract_all(c, F.lit(r"""dag_id\s*=\s*['"]([^'"]+)['"]"""), F.lit(1))
    return F.array_sort(F.array_union(generated, argument))


def ci_block(c: Column, name: str, indent: int = 0, whole_tail: bool = False) -> Column:
    """Lines indented below ``name:``; blank text when the block is missing.

    ``whole_tail`` takes everything to the end of the text once the block has
    begun, including later blocks, as a dot-matches-newline pattern would.
    """
    pad, inner = " " * indent, " " * (indent + 2)
    line = rf"{inner}(?s:.*)" if whole_tail else rf"(?:{inner}[^\n]*+\n?+)*+"  # possessive: a long block needs no stack
    return F.regexp_extract(c, rf"(?m)^{pad}\Q{name}\E:\s*\n({line})", 1)


def ci_pairs(block: Column, indent: int) -> Column:
    """(key, value) structs of ``key: value`` lines at least ``indent`` deep, quotes removed."""
    lines = F.filter(F.split(block, "\n"), lambda l: l.startswith(" " * indent) & l.contains(":"))
    return F.transform(
        lines,
        lambda l: F.struct(
            F.trim(F.regexp_extract(l, r"^([^:]*):", 1)).alias("key"),
            F.regexp_replace(F.trim(F.regexp_extract(l, r"^[^:]*:(.*)", 1)), r"""^"+|"+$""", "").alias("value"),
        ),
    )


def unquote(c: Column) -> Column:
    return F.regexp_replace(c, "^'+|'+$", "")


def last_value(pairs: Column, key: str) -> Column:
    """Value of the last pair with this key; NULL without one."""
    return F.get(F.reverse(F.filter(pairs, lambda p: p["key"] == key)), F.lit(0))["value"]


def split_names(c: Column) -> Column:
    """Trimmed non-empty parts of a comma list; empty array for NULL."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def suffix(path: Column) -> Column:
    """Lower-case file suffix; empty for names that have none or only begin with a dot."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]*)$", 1))


def is_text_path(path: Column) -> Column:
    return suffix(path).isin(TEXT_SUFFIXES)


def stem(path: Column) -> Column:
    """File name without folder and last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def substitute(c: Column, path: Column, values: Mapping[str, Column | str]) -> Column:
    """Replace ``{{ NAME }}`` tokens in text files; other files stay as they are."""
    text = c
    for name, value in values.items():
        text = F.replace(text, F.lit("{{ %s }}" % name), value if isinstance(value, Column) else F.lit(value))
    return F.when(is_text_path(path), text).otherwise(c)


def fingerprint(content: Column, path: Column) -> Column:
    """Hashes and size of a file; ``compare_hash`` ignores line ends of text files."""
    text = F.make_valid_utf8(content.cast("string"))
    exact = F.sha2(content, 256)
    return F.struct(
        exact.alias("sha256"),
        F.base64(F.unhex(F.md5(content))).alias("md5_base64"),
        F.octet_length(content).cast("bigint").alias("size_bytes"),
        F.when(is_text_path(path), F.sha2(normalize_newlines(text), 256)).otherwise(exact).alias("compare_hash"),
        is_text_path(path).alias("is_text"),
    )


def split_header(line: Column) -> Column:
    """Commit header of five ``|`` parts, the last keeping its delimiters; NULL if malformed."""
    parts = F.split(F.substr(line, F.lit(4)), r"\|", 5)
    header = F.struct(
        *[F.get(parts, F.lit(i)).alias(name) for i, name in enumerate(["commit", "created_at", "author", "author_email", "message"])]
    )
    return F.when(line.startswith("@@@") & (F.size(parts) == 5), header)


def parse_status(line: Column) -> Column:
    """``struct(raw_change_type, file_path)`` of a name-status line; NULL when too short."""
    parts = F.split(line, "\t")
    path = F.trim(F.element_at(parts, -1))
    return F.when(
        (F.size(parts) >= 2) & (path != ""),
        F.struct(F.trim(F.get(parts, F.lit(0))).alias("raw_change_type"), path.alias("file_path")),
    )


def parse_ts(c: Column) -> Column:
    """Instant of an offset ISO-8601 text; NULL when it cannot be read."""
    return F.try_to_timestamp(c)
