"""Text functions as column expressions. Missing text counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"一-鿿"


def text(c: Column) -> Column:
    """Null as '', trimmed, white space collapsed."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)\s+", " "))


def header(c: Column) -> Column:
    return F.lower(text(c))


def match_key(c: Column) -> Column:
    """Lower case, only a-z, 0-9, _ and CJK."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"[^a-z0-9_{CJK}]+", "")


def slug(c: Column, default: str = "document") -> Column:
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), f"[^a-z0-9{CJK}._-]+", "-")
    s = F.regexp_replace(F.regexp_replace(s, "-+", "-"), r"^[-._]+|[-._]+$", "")
    return F.when(s == "", F.lit(default)).otherwise(s)


def field_code(c: Column) -> Column:
    """Without leading asterisks."""
    return F.regexp_replace(text(c), r"^\*+", "")


def column_index(ref: Column) -> Column:
    """Index from 0 of a spreadsheet column: A 0, Z 25, AA 26; 0 without letters."""
    letters = F.regexp_extract(F.upper(ref), "^([A-Z]*)", 1)
    total = F.aggregate(F.split(letters, ""), F.lit(0), lambda a, x: F.when(x == "", a).otherwise(a * 26 + F.ascii(x) - 64))
    return F.greatest(total - 1, F.lit(0))


def trim_empty(cells: Column) -> Column:
    """The array without its trailing empty cells."""
    last = F.array_max(F.transform(cells, lambda c, i: F.when(text(c) != "", i + 1).otherwise(0)))
    return F.slice(cells, F.lit(1), F.coalesce(last, F.lit(0)))


#: Labels that stand for samples, not fields.
SAMPLE_LABELS = ("入参表", "出参表", "字段名", "参数名", "参数代码", "数据项代码", "返回目录")
PROSE_MARKS, JSON_MARKS = ("为", "相关", "信息", "说明"), ('":"', '":', "':")


def is_sample(c: Column) -> Column:
    """Whether a code cell is a label, note, sample or prose rather than a field."""
    t = text(c)
    n = F.lower(t)
    has = lambda marks: F.greatest(*[F.instr(t, m) for m in marks]) > 0
    return (t != "") & (n.isin(*SAMPLE_LABELS) | (n.contains("示例") & (F.length(t) <= 12)) | t.rlike(r"^(注：|注:|[{}\[\]])")
                        | (t.rlike(f"[{CJK}]") & (F.length(t) > 20) & has(PROSE_MARKS)) | ((F.length(t) > 20) & has(JSON_MARKS)))


#: What says yes and no.
NULL_NO = ("否", "n", "no", "false", "0", "not null")
NULL_YES = ("是", "y", "yes", "true", "1", "null", "nullable")
REQUIRED_NO = ("n", "no", "false", "0", "否", "非必填")


def required_from_nullable(c: Column) -> Column:
    n = header(c)
    return F.when(n.isin(*NULL_NO), "Y").when(n.isin(*NULL_YES), "N").otherwise("")


def marker_mismatch(code: Column, required: Column) -> Column:
    return text(code).startswith("*") & header(required).isin(*REQUIRED_NO)


def json_path(code: Column, context: Column) -> Column:
    """Path of a field in the part of a message that the context names; '' without either."""
    c = field_code(code)
    named = F.coalesce(context, F.lit("")).isin("headers", "request", "data", "response", "signature")
    path = F.when(named, F.concat(context, F.lit("."), c)).otherwise(F.concat(F.lit("data."), context, F.lit("."), c))
    return F.when((F.coalesce(context, F.lit("")) == "") | (c == ""), "").otherwise(path)


def interface_name(message: Column) -> Column:
    """What stands in the first ``接口[...]``, up to its first bracket; null without one."""
    inner = F.regexp_extract(message, r"接口\[(.+?)\]", 1)
    return F.when(inner != "", F.substring_index(inner, "(", 1))


def duration_ms(message: Column) -> Column:
    found = F.regexp_extract(F.coalesce(message, F.lit("")), r"耗时[：:]\s*([0-9]+)", 1)
    return F.when(found == "", F.lit(0)).otherwise(found.cast("long")).cast("long")


def last_segment(c: Column) -> Column:
    return F.substring_index(c, ".", -1)


def module_after(name: Column, root: str, skip: str) -> Column:
    """The segment after ``root`` (the one after that if it is ``skip`` and another follows)."""
    parts = F.split(name, r"\.")
    at = F.array_position(parts, root).cast("int")
    first, second = F.try_element_at(parts, at + 1), F.try_element_at(parts, at + 2)
    return F.when(at == 0, F.lit(None)).when((first == skip) & second.isNotNull(), second).otherwise(first)


def severity(ms: Column) -> Column:
    return F.when(ms > 60000, "high").when(ms > 30000, "mid").otherwise("low")


def seconds(ms: Column) -> Column:
    """Seconds with one decimal, as text, of whole milliseconds from 0 on.

    The double is rounded by its exact value, an exact half to the even digit, as C and Python
    do; ``format_string`` would round the half of the shortest decimal up.
    """
    q = ms / F.lit(1000.0)
    high = F.floor(q * 2**20) / F.lit(2.0**20)
    over = (high * 1000 - ms) + (q - high) * 1000  # what the double exceeds the fraction by, exactly
    low, half = F.floor(ms / 100), F.pmod(ms, F.lit(100)) - 50
    up = (half > 0) | ((half == 0) & ((over > 0) | ((over == 0) & (F.pmod(low, F.lit(2)) == 1))))
    tenths = low + up.cast("long")
    return F.format_string("%d.%d", F.floor(tenths / 10), F.pmod(tenths, F.lit(10)))


def escape_cell(c: Column) -> Column:
    return F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))


def markdown_row(cells: Column, width: int | Column) -> Column:
    """``| a | b |`` with the cells escaped and filled up to ``width``."""
    w = F.lit(width) if isinstance(width, int) else width
    filled = F.concat(cells, F.array_repeat(F.lit(""), F.greatest(w - F.size(cells), F.lit(0))))
    return F.concat(F.lit("| "), F.array_join(F.transform(filled, escape_cell), " | "), F.lit(" |"))


def cjk_attributes(xml: Column) -> Column:
    """How many quoted attribute values hold CJK characters."""
    return F.size(F.filter(F.regexp_extract_all(xml, F.lit(r"\w+\s*=\s*\"([^\"]*)\""), F.lit(1)), lambda v: v.rlike(f"[{CJK}]")))


def declared_encoding(xml: Column) -> Column:
    found = F.lower(F.regexp_extract(xml, r"""(?i)^\s*<\?xml[^>]*encoding\s*=\s*["']([^"']+)["']""", 1))
    return F.when(found == "", "utf-8").otherwise(found)


#: What a shared report must not hold.
REDACTION = {
    "IPv4 address": r"(?<!\d)(?:\d{1,3}\.){3}\d{1,3}(?!\d)",
    "network URL": r"(?i)\b(?:https?|sftp)://",
    "Windows absolute path": r"(?i)\b[A-Z]:\\",
    "server absolute path": r"(?i)(?:^|[\s\"'`])/(?:opt|var|home|usr|srv)/",
    "secret or connection assignment": r"(?im)\b(?:password|passwd|token|secret|account|username|namespace|remotePath)\b\s*[:=]\s*[\"']?[^\"'\s,}]+",
    "long Base64 payload": r"(?m)[A-Za-z0-9+/]{256,}={0,2}",
    "complete XML payload": r"(?i)<\?xml\s",
}


def redaction_classes(c: Column) -> Column:
    """Array of the classes of REDACTION that the text holds, in their order."""
    flags = [F.when(c.rlike(p), F.lit(name)) for name, p in REDACTION.items()]
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def temporary_failure(message: Column) -> Column:
    return F.coalesce(message.rlike(r"(?is)Execute\+[^\r\n]*<SYNTAX>"), F.lit(False))


def normal_path(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"^(\./)+", ""), "/+", "/")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def file_kind(path: Column) -> Column:
    e = extension(path)
    return F.when(e == ".cls", "class").when(e == ".csp", "page").when(e.isin(".js", ".css", ".html", ".png", ".json"), "web-asset").otherwise("other")


def with_prefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), c).otherwise(F.concat(F.lit(prefix), c))


def configured(c: Column) -> Column:
    """'' for values still to do."""
    return F.when(c.startswith("TODO"), "").otherwise(F.coalesce(c, F.lit("")))


def status(c: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(s.isin("enabled", "initialized"), "enabled").when(s == "disabled", "disabled").otherwise("available")


def is_read_sql(c: Column) -> Column:
    return F.coalesce(F.lower(F.ltrim(c)).rlike("^(select|with)"), F.lit(False))


def writes(tool: Column, args: Column, read_tools: tuple[str, ...], modes: tuple[str, ...] = ("read", "count", "explain")) -> Column:
    """Whether a tool call may write: unknown tools do; a query does unless its mode or text reads."""
    reads = tool.isin(*read_tools) | ((tool == "query") & (args["mode"].isin(*modes) | is_read_sql(args["sql"])))
    return ~F.coalesce(reads, F.lit(False))


def relaxed_map(c: Column) -> Column:
    """A JSON object of texts, or ``{k:v,k:v}`` without quotes, as a map."""
    loose = F.str_to_map(F.regexp_replace(c, r"^\s*\{|\}\s*$", ""), F.lit(","), F.lit(":"))
    return F.coalesce(F.from_json(c, "map<string,string>"), loose)


def line_ends(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def content_hash(c: Column) -> Column:
    return F.sha2(line_ends(F.regexp_replace(c, "^﻿", "")), 256)


def changed_lines(diff: Column) -> Column:
    """Lines of a diff that add or remove, without its file headers."""
    return F.size(F.filter(F.split(diff, "\n"), lambda x: x.rlike(r"^[+-]") & ~x.rlike(r"^(\+\+\+|---)")))


def placeholders(c: Column) -> Column:
    """Sorted placeholders ``{0}``, ``%1``, ``${name}`` of a text."""
    return F.array_sort(F.regexp_extract_all(c, F.lit(r"(\$\{[^}]+\}|\{[0-9]+\}|%[0-9]+)"), F.lit(1)))


def data_shape(c: Column) -> Column:
    t = F.trim(F.coalesce(c, F.lit("")))
    return (F.when(F.try_parse_json(t).isNotNull() & t.rlike(r"^[{\[]"), "json").when(t.rlike(r"^<[A-Za-z!?]"), "markup")
            .when(t.rlike(r"^[{\[]"), "json-like").when(t.rlike(r"[\^|,;]"), "delimited").otherwise("other"))


def piece(c: Column, n: int, mark: str = "^") -> Column:
    """The n-th piece, from 1, of a delimited record; '' beyond its end."""
    return F.coalesce(F.try_element_at(F.split(c, "\\" + mark), F.lit(n)), F.lit(""))


def chunks(payload: Column, size: int = 6000) -> Column:
    """The payload cut into pieces of ``size`` characters; their concatenation is the payload. A missing one counts as empty."""
    payload = F.coalesce(payload, F.lit(""))
    n = F.greatest(F.ceil(F.length(payload) / size), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(payload, i * size + 1, F.lit(size)))


def row_text(cells: Column) -> Column:
    """The cells of a row put together in lower case, without white space and parentheses of either width."""
    return F.lower(F.regexp_replace(F.array_join(F.transform(cells, text), ""), r"(?U)[\s（）()]+", ""))


def section_line(c: Column) -> Column:
    """A line without dot leaders and what follows them, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text(c), r"\.{3,}.*$", ""), r"(?U)\s+", " "))


def is_contents_line(c: Column) -> Column:
    """Whether a line has the dot leaders of a table of contents."""
    return F.coalesce(F.contains(c, F.lit("...")), F.lit(False))


def iso_time(c: Column) -> Column:
    """The moment of an ISO 8601 timestamp with date, time and zone; null for anything else."""
    shape = c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?(Z|[+-][0-9]{2}:?[0-9]{2})$")
    return F.when(shape, F.try_to_timestamp(c))


def forbidden_lines(c: Column, pattern: str) -> Column:
    """``line_no, line`` (from 1) of the lines that hold the pattern, as an array of structs."""
    lines = F.transform(F.split(line_ends(c), "\n"), lambda l, i: F.struct((i + 1).alias("line_no"), l.alias("line")))
    return F.filter(lines, lambda s: s["line"].rlike(pattern))


#: Letters that text shows when it was read in a wrong encoding.
MOJIBAKE = "[ÃÂÅåäæçèéê]"


def has_cjk(c: Column) -> Column:
    return F.coalesce(c.rlike(f"[{CJK}]"), F.lit(False))


def has_non_ascii(c: Column) -> Column:
    return F.coalesce(F.octet_length(c) > F.length(c), F.lit(False))


def has_mojibake(c: Column) -> Column:
    return F.coalesce(c.rlike(MOJIBAKE), F.lit(False))


#: What may stand beside the elements of XML, and the tags of elements.
_XML_ASIDE = r"(?s)<!--.*?-->|<[?].*?[?]>|<!\[CDATA\[.*?\]\]>|<!DOCTYPE[^>\[]*(?:\[[^\]]*\])?[^>]*>"
_XML_TAG = r"""</?[^\s<>/!?"'](?:[^<>"']|"[^"]*"|'[^']*')*+>"""


def is_well_formed_xml(c: Column) -> Column:
    """Whether a text parses as XML with one root element and nothing but comments and the like beside it."""
    read = F.from_xml(c, "_bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    bare = F.regexp_replace(F.regexp_replace(c, _XML_ASIDE, ""), r"^[\s\x{FEFF}]+|\s+$", "")

    def step(acc: Column, tag: Column) -> Column:
        ends, whole = tag.startswith("</"), tag.endswith("/>")
        depth = acc["depth"] + F.when(ends, -1).when(whole, 0).otherwise(1)
        return F.struct(depth.alias("depth"), (acc["roots"] + F.when((acc["depth"] == 0) & ~ends, 1).otherwise(0)).alias("roots"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("roots"))
    roots = F.aggregate(F.regexp_extract_all(bare, F.lit(_XML_TAG), F.lit(0)), start, step, lambda acc: acc["roots"])
    return c.isNotNull() & bare.startswith("<") & bare.endswith(">") & read["_bad"].isNull() & (roots == 1)


def language_name(code: Column, names: dict[str, str]) -> Column:
    """The language's name, else its code in capitals."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.lower(code)] if names else F.lit(None)
    return F.coalesce(known, F.upper(code))


def not_in(c: Column, states: list[str]) -> Column:
    """Whether a state is none of a list; a missing one is none."""
    return ~F.coalesce(c.isin(*states), F.lit(False))


def prefixed_texts(items: Column, keep, prefix: str, mark: str = ", ") -> Column:
    """The texts of an array for which ``keep`` holds, each after ``prefix``, put together."""
    return F.array_join(F.transform(F.filter(items, keep), lambda x: F.concat(F.lit(prefix), x)), mark)


def text_class(c: Column, dictionary: Column, external: Column, user_input: Column) -> tuple[Column, Column]:
    """(class, action) of a shown text: external and user input stay, dictionary entries are mapped, fixed
    texts are translated, and what is none of these is to be confirmed."""
    kind = (F.when(external, "external").when(user_input, "user-input").when(dictionary, "dictionary").when(c.isNull() | (F.trim(c) == ""), "unconfirmed").otherwise("fixed"))
    action = (F.when(kind.isin("external", "user-input"), "keep").when(kind == "dictionary", "map").when(kind == "fixed", "translate").otherwise("confirm"))
    return kind, action


def region_counts(text: Column, patterns: dict[str, str], start: str, end: str) -> Column:
    """How often each pattern is found in the lines of a text that lie between a line that matches ``start`` and the next one
    that matches ``end``: a struct of counts by the patterns' names. The marking lines don't count; a line that matches
    both ends a region; a region may be open at the end of the text. The lines are folded once, whatever the number of patterns. Null without a text."""
    zero = F.struct(F.lit(False).alias("inside"), *[F.lit(0).cast("long").alias(n) for n in patterns])

    def step(acc: Column, line: Column) -> Column:
        begins, ends = line.rlike(start), line.rlike(end)
        counted = acc["inside"] & ~begins & ~ends
        counts = [(acc[n] + F.when(counted, F.size(F.regexp_extract_all(line, F.lit(p), F.lit(0)))).otherwise(0)).cast("long").alias(n) for n, p in patterns.items()]
        return F.struct(F.when(ends, False).when(begins, True).otherwise(acc["inside"]).alias("inside"), *counts)

    return F.aggregate(F.split(text, "\r?\n", -1), zero, step, lambda acc: F.struct(*[acc[n].alias(n) for n in patterns]))


#: A string of a JSON text, and it with the scalar that follows it as a key. Strings are taken whole, so none is read from its inside.
_JSON_STRING = r'"(?:[^"\\]|\\.)*+"'
_JSON_PAIR = rf"(?s)({_JSON_STRING})(?:\s*+:\s*+({_JSON_STRING}|-?[0-9][0-9.eE+-]*+|true|false)?+)?+"


def key_values(key: str):
    """A function of a JSON text: the distinct scalar texts, whatever their case, of a key at any depth, in the order of the text; the first
    spelling stays. Blank ones and nulls are left out; null for what is no JSON or repeats a key in one object. The text is read once, from left to right, whatever its depth."""
    def plain(token: Column) -> Column:
        return F.when(token.startswith('"'), F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>")[0]).otherwise(token)

    def run(c: Column) -> Column:
        names, values = (F.regexp_extract_all(c, F.lit(_JSON_PAIR), F.lit(n)) for n in (1, 2))
        pairs = F.filter(F.arrays_zip(names.alias("k"), values.alias("v")), lambda x: (x["v"] != "") & (F.lower(plain(x["k"])) == key.lower()))
        found = F.filter(F.transform(pairs, lambda x: plain(x["v"])), lambda v: F.trim(v) != "")
        once = F.aggregate(found, F.array().cast("array<string>"), lambda acc, v: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(v)), acc).otherwise(F.array_append(acc, v)))
        return F.when(F.try_parse_json(c).isNotNull(), once)

    return run


def without_block(c: Column, title: str) -> Column:
    """The text without the blocks that a line ``title`` opens: that line and all up to the line ``}`` that closes
    its braces (braces count on lines of their own)."""
    def step(acc: Column, line: Column) -> Column:
        trimmed = F.trim(line)
        opens = ~acc["inside"] & (line == title)
        depth = F.when(acc["inside"] & (trimmed == "{"), acc["depth"] + 1).when(acc["inside"] & (trimmed == "}") & (acc["depth"] > 0), acc["depth"] - 1).otherwise(acc["depth"])
        ends = acc["inside"] & (trimmed == "}") & (acc["depth"] == 1)
        kept = F.when(acc["inside"] | opens, acc["out"]).otherwise(F.concat(acc["out"], F.array(line)))
        return F.struct(kept.alias("out"), ((acc["inside"] | opens) & ~ends).alias("inside"), depth.alias("depth"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("inside"), F.lit(0).alias("depth"))
    return F.aggregate(F.split(line_ends(c), "\n"), start, step, lambda acc: F.array_join(acc["out"], "\n"))


def reassembled(pieces: Column, count: Column) -> Column:
    """The payload of (``place``, ``piece``) structs put together in order of their places; null unless there are
    ``count`` of them, numbered from 0."""
    ordered = F.array_sort(pieces)
    whole = F.size(pieces) == count
    numbered = F.forall(F.transform(ordered, lambda p, i: p["place"] == i), lambda ok: ok)
    return F.when(whole & numbered, F.array_join(F.transform(ordered, lambda p: p["piece"]), ""))


def connection_warnings(check: Column) -> Column:
    """What is to be said about a connection check (struct of ``fallback_warning, connected, config_file, namespace,
    port``), as an array: its own warning, and that it is not connected or else looks like the defaults."""
    own = F.trim(F.coalesce(check["fallback_warning"], F.lit("")))
    connected = F.coalesce(check["connected"], F.lit(False))
    defaults = (F.coalesce(check["config_file"], F.lit("")) == "") & (F.coalesce(check["namespace"] == "USER", F.lit(False)) | F.coalesce(check["port"].cast("string") == "52773", F.lit(False)))
    said = F.array(F.when(own != "", own), F.when(~connected, F.lit("not connected: probe before relying on it")).when(defaults, F.lit("looks like the defaults: verify the target")))
    return F.filter(said, lambda x: x.isNotNull())
