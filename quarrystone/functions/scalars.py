"""Scalar functions over texts as Column expressions: built-ins only, so they stay in generated code or at least in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numerals, units and the quotation marks of the texts.
NUMERALS = {"零": 0, "〇": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100}
QUOTES = [("“", "”"), ("「", "」"), ("『", "』"), ('"', '"')]
BRACKETS = ("［］【】〔〕", "[][][]")
CONTENT_MARK = "【分析问题】"


def numeral(text: Column) -> Column:
    """A number in digits or in numerals up to the hundreds; null for anything else. A unit without a digit before it counts once."""
    t, zero = F.trim(text), F.lit(0)

    def step(acc: Column, c: Column) -> Column:
        digit = reduce(lambda out, kv: F.when(c == kv[0], F.lit(kv[1])).otherwise(out), NUMERALS.items(), zero)
        unit = reduce(lambda out, kv: F.when(c == kv[0], F.lit(kv[1])).otherwise(out), UNITS.items(), zero)
        total = acc["total"] + F.when(unit > 0, F.when(acc["now"] > 0, acc["now"]).otherwise(F.lit(1)) * unit).otherwise(zero)
        return F.struct(total.alias("total"), F.when(unit > 0, zero).otherwise(digit).alias("now"))

    start = F.struct(zero.alias("total"), zero.alias("now"))
    folded = F.aggregate(F.split(t, ""), start, step, lambda a: a["total"] + a["now"]).cast("long")
    return F.when(t.rlike("^[0-9]+$"), t.try_cast("long")).when(t.rlike(f"^[{''.join([*NUMERALS, *UNITS])}]+$"), folded)


def article_number(label: Column) -> Column:
    """The number of an article's label at the start of a text."""
    found = F.regexp_extract(label, rf"^第\s*([{''.join([*NUMERALS, *UNITS])}0-9]+)\s*条", 1)
    return F.when(found != "", numeral(found))


def words(text: Column) -> Column:
    """Search terms in order: runs of ASCII letters and digits, lower-cased, and the pairs of neighbours in runs of Han letters
    (a single one is a term itself). Full-width ASCII counts as ASCII; null is empty."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    plain = F.lower(F.translate(F.coalesce(text, F.lit("")), wide + "　", "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    runs = F.regexp_extract_all(plain, F.lit("[a-z0-9]+|[\\u4e00-\\u9fff]+"), 0)
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike("^[a-z0-9]") | (F.length(r) == 1), F.array(r)).otherwise(pairs(r))))


def broken_name(path: Column) -> Column:
    """Whether a path holds the replacement character or one of the private use area."""
    return path.rlike("[\\uFFFD\\uE000-\\uF8FF]")


def quoted_terms(text: Column) -> Column:
    """What stands between curved quotation marks, trimmed, each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit("“([^”]+)”"), 1), lambda x: F.trim(x)), lambda x: x != ""))


def sub_questions(stem: Column) -> Column:
    """The numbered parts ``（n）`` of what follows the mark of the questions; none without the mark."""
    at = F.instr(stem, CONTENT_MARK)
    body = F.substr(stem, (at + len(CONTENT_MARK)).cast("int"))
    parts = F.transform(F.split(body, r"[（(]\d{1,2}[）)]"), lambda x: F.trim(x))
    return F.when(at > 0, F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x != "")).otherwise(F.array().cast("array<string>"))


def options(text: Column, letters: str = "ABCDEFGH") -> Column:
    """``A. … B. …`` as a map. The letters count only in their order; one after a letter or a digit is part of the text."""
    mark = lambda x: rf"(?<![A-Za-z0-9]){x}[.．]\s*"
    rest, keys, values = text, [], []
    alive = F.lit(True)
    for i, x in enumerate(letters):
        nxt = mark(letters[i + 1]) if i + 1 < len(letters) else None
        halves = F.split(F.regexp_replace(rest, f"^{x}[.．]\\s*", ""), nxt, 2) if nxt else F.array(F.regexp_replace(rest, f"^{x}[.．]\\s*", ""))
        keys.append(F.when(alive, F.lit(x)))
        values.append(F.when(alive, F.trim(halves[0])))
        alive, rest = alive & (F.size(halves) > 1), F.concat(F.lit(f"{letters[i + 1]}."), F.get(halves, F.lit(1))) if nxt else rest
    return F.map_from_arrays(F.array_compact(F.array(*keys)), F.array_compact(F.array(*values)))


def scoring(text: Column) -> Column:
    """Points and weights in percent of an answer key: ``（n）（占40%）point；`` or ``（n）point（40%）；``."""
    first = F.regexp_extract_all(text, F.lit(r"[（(]占(\d{1,3})[%％][）)]"), 1)
    bodies = F.slice(F.split(text, r"[（(]占\d{1,3}[%％][）)]"), F.lit(2), F.greatest(F.size(first), F.lit(1)))
    bodies = F.transform(bodies, lambda b: F.btrim(F.regexp_replace(b, r"[；;]?\s*[（(]\d{1,2}[）)]\s*$", ""), F.lit("；; ")))
    pattern = F.lit(r"[（(]\d{1,2}[）)]([^（(]*)[（(](\d{1,3})[%％][）)]")
    later = F.regexp_extract_all(text, pattern, 2)
    points = F.transform(F.regexp_extract_all(text, pattern, 1), lambda b: F.btrim(b, F.lit("；; ")))
    pair = lambda p, w: F.zip_with(p, w, lambda a, b: F.struct(a.alias("point"), b.cast("int").alias("weight")))
    return F.when(F.size(first) > 0, pair(bodies, first)).otherwise(pair(points, later))


def markers(text: Column, kinds: str = "SCQP") -> Column:
    """Reference marks in one form: full-width brackets become square ones, and blanks inside go; letters are upper case."""
    out = F.translate(text, *BRACKETS)
    for k in kinds:
        out = F.regexp_replace(out, rf"\[\s*[{k}{k.lower()}]\s*(\d+)\s*\]", f"[{k}$1]")
    return out


def squashed(text: Column) -> Column:
    """Letters and digits of any script, lower-cased."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", ""))


def without_made_up_quotes(text: Column, originals: Column, least: int = 8) -> Column:
    """``text`` without the quotations of at least ``least`` letters that are in none of the ``originals`` word for word, tidied."""
    pool, out = F.transform(originals, squashed), text
    for left, right in QUOTES:
        inner = f"[^{left}{right}\n]{{1,400}}" if left != right else f"[^{left}\n]{{1,400}}"
        found = F.regexp_extract_all(out, F.lit(f"{left}({inner}){right}"), 1)
        bad = F.filter(found, lambda q: (F.length(squashed(q)) >= least) & ~F.exists(pool, lambda p: F.contains(p, squashed(q))))
        out = F.aggregate(bad, out, lambda acc, q: F.replace(acc, F.concat(F.lit(left), q, F.lit(right)), F.lit("")))  # noqa: B023
    for pattern, by in ((r"([：:，,])\s*([。；！？.;!?])", "$2"), (r"([。；！？])\1+", "$1"), (r"[（(]\s*[）)]", ""), (r"[ \t]{2,}", " ")):
        out = F.regexp_replace(out, pattern, by)
    return out


def prose_date(text: Column) -> Column:
    """The first ``Y年M月D日`` of a text as a date; null where there is none or it isn't a day."""
    part = lambda i: F.regexp_extract(text, r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日", i)
    return F.try_make_timestamp(part(1).try_cast("int"), part(2).try_cast("int"), part(3).try_cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date")


def opening_date(lines: Column, first: int = 6) -> Column:
    """The date of the first of the opening lines that is a bracketed note beginning with one."""
    dated = F.filter(F.slice(lines, 1, first), lambda x: F.trim(x).rlike(r"^[（(]\s*\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日.*[）)]$"))
    return prose_date(F.get(dated, F.lit(0)))


def off_peak(ts: Column) -> Column:
    """Whether a UTC time is outside 9 to 12 and 14 to 18 o'clock at UTC+8."""
    h = F.hour(F.from_utc_timestamp(ts, "Asia/Shanghai"))
    return ~(h.between(9, 11) | h.between(14, 17))


def merged(keys: list[str], *layers: Column) -> Column:
    """A map of all ``keys``, null where no layer has them; later layers win. Null layers are empty."""
    look = lambda k: F.coalesce(*[F.element_at(x, k) for x in reversed(layers)], F.lit(None))
    return F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*[look(k) for k in keys]))


def predicate(items: list[str]) -> Column:
    """``KEY=VALUE`` items as one condition; none is true for every row."""
    out = F.lit(True)
    for item in items:
        key, eq, value = item.partition("=")
        if not eq or not key.strip():
            raise ValueError(f"not of the form KEY=VALUE: {item!r}")
        out = out & (F.col(key.strip()) == value.strip())
    return out
