"""Personal data with DataFrame operations only.

Regular expressions propose spans, checksums confirm them, and words nearby adjust each
span's score. Every expression finds its matches in linear time on any text: quantifiers
are possessive and matches begin only where a run begins (or the last match ended), so
neither long runs nor the matcher's stack grow out of hand.

All matches of an expression come from one replacement that puts a mark around each,
and one split at the marks: the odd pieces are the matches, and the pieces' lengths
give their places in code points. What depends on the match before is folded in short
stretches (`folds`), and text is cut out of blocks, so many matches in a long text cost
little more than few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbside.llm.common import documents, row_key
from curbside.llm.folds import fold, let, piece, places, text_blocks

#: Score of a confirmed span, and what a word nearby adds.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
NEARBY = 0.3
#: Characters looked at before and behind a span.
REACH = 40
#: Kinds with spans below this score are left out; the base kinds are all above.
LEAST = 0.5

_RUN = r"(?:\G|(?<![{0}]))"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: In the order in which spans of one start are listed. The last two are the method's own.
PATTERNS = {
    "email": _RUN.format(r"A-Za-z0-9._%+-")
    + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _RUN.format("0-9") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # A number's head; the group looks ahead at the longest it can be. See _ibans.
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?+[A-Z0-9]){11,30}+[A-Za-z0-9]?+))",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
WORDS = {
    "email": "e-?mail|mail|contact|write",
    "ip": "ip|address|host|server",
    "card": "card|visa|credit|debit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|transfer",
    "ssn": "ssn|social|security",
}
#: Characters of each country's IBANs.
_IBAN_LENGTHS = {
    country: int(length) for length, countries in (line.split(":") for line in (
        "15:NO", "16:BE", "18:DK FI FK FO GL NL SD", "19:MK SI", "20:AT BA EE KZ LT LU MN XK",
        "21:CH HR LI LV", "22:BG BH CR DE GB GE IE ME RS VA", "23:AE GI IL IQ OM SO TL",
        "24:AD CZ ES MD PK RO SA SE SK TN VG", "25:LY PT ST", "26:IS TR", "27:BI DJ FR GR IT MC MR SM",
        "28:AL AZ BY CY DO GT HN HU LB NI PL SV", "29:BR EG PS QA UA", "30:JO KW MU YE", "31:MT SC",
        "32:LC", "33:RU",
    )) for country in countries.split()
}
#: A character no assigned text uses, to mark matches with; texts that do have it take
#: two passes instead.
_MARK = "﷐"
_SPANS = "array<struct<start:int,place:int,end:int,kind:string,score:double>>"


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(total, i):
        digit = F.substring(digits, n - i, F.lit(1)).cast("int")
        double = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 1, double).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def _mod_97(code: Column) -> Column:
    moved = F.concat(F.substring(code, 5, 40), F.substring(code, 1, 4))

    def step(rest, c):
        point = F.ascii(c)
        return F.when(point < 65, (rest * 10 + point - 48) % 97).otherwise(
            (rest * 100 + point - 55) % 97
        )

    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def _confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(14, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _parts(kind: str) -> Column:
    """Text between matches and matches in turn; null for none."""
    text, pattern = F.col("text"), F.lit(PATTERNS[kind])
    marked = F.split(F.regexp_replace(text, pattern, F.lit(f"{_MARK}$0{_MARK}")), _MARK)
    between = F.split(text, PATTERNS[kind], -1)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    slow = F.flatten(F.zip_with(between, matches, lambda x, y: F.array(x, F.coalesce(y, F.lit("")))))
    return F.when(F.instr(text, _MARK) == 0, marked).otherwise(slow)


def _iban_heads() -> Column:
    """Start of each head, and the words from there on that its number can reach into."""
    parts = F.col("iban_parts")
    tails = F.regexp_extract_all("text", F.lit(PATTERNS["iban"]), F.lit(1))
    return F.when(F.size(parts) > 2, let(F.col("iban_at"), lambda at: F.transform(
        tails, lambda tail, i: F.struct(
            F.get(at, 2 * i + 1).alias("start"),
            F.split(F.concat(F.get(parts, 2 * i + 1), tail), " ").alias("words"),
        )
    )))


def _iban_size(words: Column) -> Column:
    """Characters of the number that `words` begin with, null for none: one that mod-97
    confirms and that ends with a word, of the country's length or else the longest."""
    lengths = F.create_map(*(F.lit(x) for pair in _IBAN_LENGTHS.items() for x in pair))

    def code(n):
        return F.array_join(F.slice(words, 1, n), "")

    def confirmed(n):
        return F.length(code(n)).between(15, 34) & code(n).rlike("^[A-Z0-9]+$") & _mod_97(code(n))

    def own(n):
        return F.length(code(n)) == F.try_element_at(lengths, F.substring(code(n), 1, 2))

    numbers = F.filter(F.sequence(F.lit(1), F.size(words)), confirmed)
    best = F.coalesce(F.array_max(F.filter(numbers, own)), F.array_max(numbers))
    return F.length(F.array_join(F.slice(words, 1, best), " "))


def _ibans() -> Column:
    """Start and end of each number, from the first on; heads inside one are its own."""
    sized = F.transform("iban_heads", lambda h: F.struct(
        h["start"].alias("start"), (h["start"] + _iban_size(h["words"])).alias("end")
    ))
    return F.filter(sized, lambda s: s["end"].isNotNull())


def _apart(sized: Column) -> Column:
    """Those that begin where the last one taken has ended."""

    def step(last, s):
        fits = s["start"] >= last
        return F.when(fits, s["end"]).otherwise(last), F.when(fits, s)

    return fold(sized, F.lit(0), "struct<start:int,end:int>", step)["all"]


def _iban_spans() -> Column:
    found, text = F.col("iban_found"), F.col("iban_blocks")

    def span(s, i):
        floor = F.greatest(F.coalesce(F.get(found, i - 1)["end"], F.lit(0)), s["start"] - REACH)
        limit = F.coalesce(F.get(found, i + 1)["start"], F.length("text"))
        before = piece(text, floor, s["start"])
        after = piece(text, s["end"], F.least(limit, s["end"] + REACH))
        return _span("iban", s["start"], s["end"], F.concat_ws(" ", before, after))

    return F.coalesce(F.transform(found, span), F.array().cast(_SPANS))


def _span(kind: str, start: Column, end: Column, near: Column) -> Column:
    words = rf"(?i)\b(?:{WORDS[kind]})\b"
    score = F.lit(SCORES[kind]) + F.when(near.rlike(words), NEARBY).otherwise(0.0)
    return F.struct(
        start.alias("start"),
        F.lit(list(PATTERNS).index(kind)).alias("place"),
        end.alias("end"),
        F.lit(kind).alias("kind"),
        F.least(F.round(score, 2), F.lit(1.0)).alias("score"),
    )


def _spans(kind: str) -> Column:
    if kind == "iban":
        return _iban_spans()
    parts, at = F.col(f"{kind}_parts"), F.col(f"{kind}_at")

    def span(i):
        near = F.concat_ws(
            " ", F.right(F.get(parts, i - 1), F.lit(REACH)), F.left(F.get(parts, i + 1), F.lit(REACH))
        )
        return _span(kind, F.get(at, i), F.get(at, i) + F.length(F.get(parts, i)), near)

    odd = F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))
    real = F.filter(odd, lambda i: (F.get(parts, i) != "") & _confirmed(kind, F.get(parts, i)))
    found = F.filter(F.transform(real, span), lambda s: s["score"] >= LEAST)
    return F.when(F.size(parts) > 2, found).otherwise(F.array().cast(_SPANS))


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, text, spans (start, end in code points, end exclusive; kind; score),
    sorted by start, then by the order of PATTERNS.

    Matches of one kind don't overlap, those of different kinds may. Null texts are empty
    and have no spans. Each row is judged on its own: repeated rows, null ids and other
    columns make no difference.
    """
    rows = documents(docs, key, text).withColumn("text", F.coalesce("text", F.lit("")))
    return with_spans(rows).select("doc_id", "text", "spans")


def with_spans(rows: DataFrame) -> DataFrame:
    """`rows` (with `text`, not null) and their `spans`. Expressions a later one uses more
    than once stand in a projection of their own, to be computed once."""
    kept = rows.columns
    for kind in PATTERNS:
        rows = rows.withColumn(f"{kind}_parts", _parts(kind))
    rows = rows.withColumns({
        f"{kind}_at": F.when(F.size(f"{kind}_parts") > 2, places(F.col(f"{kind}_parts")))
        for kind in PATTERNS
    })
    rows = rows.withColumn("iban_heads", _iban_heads()).withColumn("iban_sized", _ibans())
    rows = rows.withColumns({
        "iban_found": F.when(F.size("iban_sized") > 0, _apart(F.col("iban_sized"))),
        "iban_blocks": F.when(F.size("iban_sized") > 0, text_blocks(F.col("text"))),
    })
    found = F.sort_array(F.concat(*(_spans(kind) for kind in PATTERNS)))
    return rows.select(*kept, F.transform(found, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"),
        s["score"].alias("score"),
    )).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    ), ",")


def _merged(spans: Column) -> Column:
    """Maximal stretches of overlapping spans, each of the kind of its first."""
    kind = "struct<start:int,end:int,kind:string>"
    none = F.lit(None).cast(kind)

    def step(last, s):
        inside = s["start"] < last["end"]
        own = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        longer = F.struct(
            last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"),
            last["kind"].alias("kind"),
        )
        return F.when(inside, longer).otherwise(own), F.when(inside, none).otherwise(last)

    whole = F.array(fold(spans, none, kind, step))
    return F.get(F.transform(
        whole, lambda w: F.array_compact(F.array_append(w["all"], w["carry"]))
    ), F.lit(0))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with every span of `text` replaced by its kind in brackets; of overlapping
    spans by the first one's. Rows without spans, and null texts, stay as they are; so do
    null ids, repeated rows, and all other columns, whatever their names."""
    rows = docs.select(
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.struct(*docs.columns).alias("_row"),
    )
    found = with_spans(rows).withColumns({
        "cuts": F.when(F.size("spans") > 0, _merged(F.col("spans"))),
        "blocks": F.when(F.size("spans") > 0, text_blocks(F.col("text"))),
    })

    def part(cut, i):
        before = F.coalesce(F.get("cuts", i - 1)["end"], F.lit(0))
        return F.concat(
            piece(F.col("blocks"), before, cut["start"]), F.lit("["), F.upper(cut["kind"]), F.lit("]")
        )

    rest = piece(F.col("blocks"), F.element_at("cuts", -1)["end"], F.length("text"))
    new = F.when(F.col("cuts").isNull(), F.col(f"_row.{text}")).otherwise(
        F.concat(F.array_join(F.transform("cuts", part), ""), rest)
    )
    return found.select(*(
        new.alias(text) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns
    ))


__all__ = ["PATTERNS", "find_personal_data", "listed", "redact", "row_key", "with_spans"]
