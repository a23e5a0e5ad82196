"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust their scores.

Only DataFrame functions. Where a pattern matches is read off the lengths of the pieces between its matches. The patterns
are those of the base contract made linear: possessive where no backtracking can help, and barred from starting inside a
run whose start has already failed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
SSN = r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])"
#: Lengths of IBANs by country.
COUNTRIES = {15: "NO", 16: "BE", 18: "DK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
_IBANS = "(?:" + "|".join(f"(?:{'|'.join(c.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in COUNTRIES.items()) + ")"
IBAN = f"(?<![A-Za-z0-9_]){_IBANS}(?![A-Za-z0-9_])"

#: kind, pattern, what a text must contain to have a match, score of a confirmed span, words that raise it
KINDS = (
    ("email", EMAIL, "@", 0.9, ("mail", "contact", "write")),
    ("ip", IP, ".", 0.7, ("ip", "host", "server", "address")),
    ("card", CARD, None, 0.8, ("card", "visa", "credit", "payment")),
    ("phone", PHONE, "+", 0.6, ("phone", "call", "tel", "mobile")),
    ("iban", IBAN, None, 0.9, ("iban", "bank", "account")),
    ("ssn", SSN, "-", 0.4, ("ssn", "social", "security")),
)
BASE = ("email", "ip", "card", "phone")
CONTEXT, RAISE, THRESHOLD = 40, 0.3, 0.5


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.transform(F.split(F.reverse(number), ""), worth), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN's country, check digits and body leave 1 modulo 97."""
    s = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))

    def step(a: Column, c: Column) -> Column:
        v = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.when(v < 10, (a * 10 + v) % 97).otherwise((a * 100 + v) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def confirmed(kind: str, m: Column) -> Column:
    """Whether a proposed match stands."""
    n = F.length(digits(m))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.coalesce(F.right(p, F.lit(9)).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return n.between(14, 19) & luhn(digits(m))
    if kind == "phone":
        return n.between(10, 15)
    if kind == "iban":
        return F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34) & mod97(m)
    return F.lit(True)


#: Spans are placed in runs of RUN: a span's place is the sum over the runs before, and over those before it in its run.
RUN = 128


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is evaluated once and not at each place (inside a lambda, for every element)."""
    return F.transform(F.array(value), body)[0]


def proposed(t: Column, at: int) -> Column:
    """array<struct<start, ord, end, m, near>> of one kind; code points, end exclusive.

    near: up to CONTEXT characters before a span, a line feed, and up to CONTEXT after it, none from other spans of the kind.
    """
    _, pattern, needs, _, _ = KINDS[at]
    found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:int,ord:int,end:int,m:string,near:string>>")

    def pieces(gaps: Column) -> Column:
        parts = F.zip_with(F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g"))), F.slice(gaps, F.lit(2), F.size(gaps)), lambda p, a: F.struct(p["m"].alias("m"), F.length(p["m"]).alias("n"), F.length(p["g"]).alias("g"), F.concat(F.right(p["g"], F.lit(CONTEXT)), F.lit("\n"), F.left(a, F.lit(CONTEXT))).alias("near")))
        return F.filter(parts, lambda x: x["m"].isNotNull())  # there is one gap more

    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x["g"] + x["n"])
    runs = lambda every: F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / RUN).cast("int")), lambda k: F.slice(every, k * RUN + 1, F.lit(RUN)))

    def place(run: Column, before: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            return bound(before + total(F.slice(run, F.lit(1), i)) + x["g"], lambda start: F.struct(start.alias("start"), F.lit(at).alias("ord"), (start + x["n"]).alias("end"), x["m"].alias("m"), x["near"].alias("near")))

        return F.transform(run, one)

    def placed(rs: Column) -> Column:
        sums = F.transform(rs, total)
        return bound(sums, lambda s: F.flatten(F.transform(rs, lambda r, k: bound(F.aggregate(F.slice(s, F.lit(1), k), F.lit(0), lambda x, y: x + y), lambda before: place(r, before)))))

    spans = bound(F.split(t, pattern, -1), lambda gaps: bound(pieces(gaps), lambda every: F.when(F.size(every) > 0, bound(runs(every), placed)).otherwise(empty)))
    return F.when(F.contains(t, F.lit(needs)), spans).otherwise(empty) if needs else F.when(F.regexp_like(t, F.lit(pattern)), spans).otherwise(empty)


def rated(at: int) -> Column:
    """The confirmed spans of one kind in column p_<kind>, as array<struct<start, ord, end, score>>."""
    kind, _, _, score, words = KINDS[at]
    told = F.lit("(?:^|[^a-z0-9])(?:" + "|".join(words) + ")")

    def rate(s: Column) -> Column:
        value = F.when(F.regexp_like(F.lower(s["near"]), told), F.lit(min(1.0, score + RAISE))).otherwise(F.lit(score))
        return F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), value.alias("score"))

    spans = F.transform(F.filter(F.col(f"p_{kind}"), lambda s: confirmed(kind, s["m"])), rate)
    return spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= THRESHOLD)


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores.

    The base spans (email, ip, card, phone) always stay. The method adds IBANs of their country's length that pass mod-97,
    and numbers of the form of a social security number if a context word stands within CONTEXT characters around them
    (score of THRESHOLD or more); their overlap with base spans is allowed. A null text counts as empty and has no spans; a
    text of any length is searched whole, in linear time; repeated rows come out repeated; other columns don't matter. An
    empty table gives an empty result.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), t.alias("t")).select("doc_id", "t", *[proposed(F.col("t"), k).alias(f"p_{kind}") for k, (kind, *_) in enumerate(KINDS)])
    df = df.select("doc_id", *[rated(k).alias(f"s_{kind}") for k, (kind, *_) in enumerate(KINDS)])
    names = F.array(*[F.lit(k[0]) for k in KINDS])

    def joined(spans: Column, what: str) -> Column:
        value = {"span": lambda s: F.concat_ws(":", F.element_at(names, s["ord"] + 1), s["start"], s["end"]), "score": lambda s: F.format_number(s["score"], 2)}[what]
        return F.array_join(F.transform(spans, value), ",")

    base = F.array_sort(F.concat(*[F.col(f"s_{k}") for k in BASE]))
    every = F.array_sort(F.concat(*[F.col(f"s_{k[0]}") for k in KINDS]))
    return df.select("doc_id", *[F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in BASE], F.sha2(joined(base, "span"), 256).alias("base_sha256"), joined(every, "span").alias("spans"), joined(every, "score").alias("scores"))


# The same in DuckDB's SQL: base patterns as the contract has them (its engine is linear and has no look-around).

_SQL_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"\b{_IBANS}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN c::INT * 2 - 9 ELSE c::INT * 2 END)) % 10 = 0"
_TURNED = "substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4)"
_VALUES = f"list_transform(string_split({_TURNED}, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)"
_SQL_CHECKS = {
    "email": "true",
    "ip": "len(list_filter(string_split(m, '.'), lambda p: COALESCE(TRY_CAST(p AS HUGEINT) <= 255, false))) = 4",
    "card": f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}",
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
    "iban": f"length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, {_VALUES}), lambda a, v: CASE WHEN v < 10 THEN (a * 10 + v) % 97 ELSE (a * 100 + v) % 97 END) = 1",
    "ssn": "true",
}


def oracle_sql() -> str:
    """find_pii over documents. Rows are told apart by number, as they may repeat."""
    parts = []
    for k, (kind, _, _, score, words) in enumerate(KINDS):
        pattern = _SQL_PATTERNS[kind]
        near = f"lower(right(b, {CONTEXT}) || chr(10) || left(a, {CONTEXT}))"
        told = f"CASE WHEN regexp_matches({near}, '(?:^|[^a-z0-9])(?:{'|'.join(words)})') THEN {min(1.0, score + RAISE)}::DOUBLE ELSE {score}::DOUBLE END"
        found = f"""SELECT r, m, b, a, s, s + length(m) AS e FROM (
  SELECT r, ms[i] AS m, gs[i] AS b, gs[i + 1] AS a, list_sum(list_transform(gs[1:i], lambda x: length(x)))::BIGINT + COALESCE(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s
  FROM (SELECT r, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gs FROM d)))"""
        parts.append(f"SELECT r, {k} AS o, '{kind}' AS kind, s, e, {told} AS score FROM ({found}) WHERE {_SQL_CHECKS[kind]}")
    spans = " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)
    base = ", ".join(f"COALESCE(n_{k}, 0) AS n_{k}" for k in BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    joined = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o, e)"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, COALESCE(text, '') AS t FROM documents),
p AS (SELECT * FROM ({spans}) WHERE o < {len(BASE)} OR score >= {THRESHOLD}),
g AS (SELECT r, {counts}, {joined} FILTER (o < {len(BASE)}) AS base, {joined} AS spans, string_agg(printf('%.2f', score), ',' ORDER BY s, o, e) AS scores FROM p GROUP BY r)
SELECT doc_id, {base}, sha256(COALESCE(base, '')) AS base_sha256, COALESCE(spans, '') AS spans, COALESCE(scores, '') AS scores FROM d LEFT JOIN g USING (r)"""
