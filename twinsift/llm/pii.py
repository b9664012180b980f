"""Personal data by regular expressions, checksums and the words around what they find.

Expressions propose spans.  Validators decide: numbers of cards pass Luhn's check, account
numbers (IBAN) have their country's length and leave 1 modulo 97, parts of addresses are 255 at
most, telephone numbers have 9 to 15 digits, social security numbers no part that is never given
out.  Each span scores ``BASE_SCORE`` of its kind, raised if a context word of its kind stands in
the 40 characters before it (and behind the proposal before).  E-mail, ip, card and phone
spans that pass their validators always stay; a span of the method's own (iban, ssn) needs
``least_score``, which an ssn only reaches with a context word.

Where a match stands is told by the pieces between the matches, which ``split`` returns:
their lengths and the matches' add up.  Running sums (and, where spans are replaced, running
maxima) are taken in three levels of ``RUN`` values, so that the work is near the number of
proposals.  Expressions are written so that Java's engine neither goes back over a long run nor
recurses, and so works through very long texts.

Null texts are read as empty and have no spans; a text and all of a null id's rows are scanned like
others; repeated rows are scanned each for itself; an empty table gives an empty result.  Columns
other than id and text are left out, whatever their names.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
#: The kinds whose spans stay, whatever their score.
BASE_KINDS = KINDS[:4]

#: How many characters an IBAN has, by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}

#: A possessive form of each kind's expression: same matches, no going back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": "(?<![A-Za-z0-9])(?:" + "|".join(
        rf"(?:{'|'.join(names.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_LENGTHS.items()
    ) + ")(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Characters without which a text can't hold a match.
NEEDS = {"email": "@", "phone": "+", "ip": ".", "card": None, "iban": None, "ssn": None}
BASE_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.5, "iban": 0.7, "ssn": 0.4}
CONTEXT_SCORE, CONTEXT_WIDTH, LEAST_SCORE = 0.3, 40, 0.6
#: Values of a run, and characters of a piece from which spans are cut.
RUN, PIECE = 64, 256
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|kontakt|courriel|correo)",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse)",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|karte|carte|tarjeta)",
    "phone": r"(?i)\b(?:phone|call|tel|mobile|fax|anruf|appel|llama)",
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)",
    "ssn": r"(?i)\b(?:ssn|social security|sozialversicherung|sécurité sociale|seguridad social)",
}


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    places = F.sequence(F.lit(0), F.length(digits) - 1)
    doubled = F.transform(
        places,
        lambda i: (F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int") * (1 + i % 2)),
    )
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return total % 10 == 0


def mod97(account: Column) -> Column:
    """The remainder of an account number, its first four characters moved to the end."""
    plain = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    places = F.sequence(F.lit(1), F.length(turned))
    value = lambda i: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substring(turned, i, F.lit(1))) - 1
    return F.aggregate(
        places, F.lit(0), lambda a, i: (a * F.when(value(i) > 9, 100).otherwise(10) + value(i)) % 97
    )


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda x: F.ltrim(x, F.lit("0")))
        small = lambda x: F.when(F.length(x) < 4, F.concat(F.lit("0"), x).cast("int"))
        return F.forall(parts, lambda x: F.coalesce(small(x), F.lit(256)) <= 255)
    if kind == "card":
        fits = F.length(digits).between(13, 19)
        return fits & luhn(F.when(fits, digits).otherwise("1"))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(match) == 1
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)|-00-|0000$")
    return F.lit(True)


def _proposed(kind: str, text: Column) -> tuple[Column, Column]:
    """Matches and the pieces between them; both empty where a needed character is missing."""
    pattern = PATTERNS[kind]
    matches, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.array().cast("array<string>")
    if kind == "card":
        there = text.rlike("[0-9][0-9\\x20-]{11}")
    elif kind == "iban":
        there = text.rlike("[A-Z]{2}[0-9]{2}[\\x20A-Z0-9]")
    elif kind == "ssn":
        there = text.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}")
    elif kind == "ip":
        there = text.rlike(r"[0-9]\.[0-9]")
    else:
        there = F.contains(text, F.lit(NEEDS[kind]))
    return F.when(there, matches).otherwise(none), there, between


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for a value that is worked out once, also if lambdas use it."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _running(values: str, merge: Callable[[str, str], str]) -> str:
    """For each of an array's numbers all before it merged, 0 for the first."""
    runs = lambda a: f"transform(sequence(0, cast((size({a}) - 1) div {RUN} as int)), c -> slice({a}, c * {RUN} + 1, {RUN}))"
    total = lambda a: f"transform({a}, r -> aggregate(r, 0, (t, v) -> {merge('t', 'v')}))"

    def each(run: str, start: str) -> str:
        return (
            f"aggregate({run}, struct({start} as at, cast(array() as array<int>) as done), "
            f"(t, v) -> struct({merge('t.at', 'v')} as at, concat(t.done, array(t.at)) as done), t -> t.done)"
        )

    spread = lambda a, starts: f"flatten(zip_with({a}, {starts}, (r, s) -> {each('r', 's')}))"
    body = spread("c1", "p1")
    for name, value in (
        ("p1", spread("c2", "p2")), ("p2", each("t2", "0")), ("t2", total("c2")), ("c2", runs("t1")),
        ("t1", total("c1")), ("c1", runs("v0")), ("v0", values),
    ):
        body = _let(value, name, body)
    return body


def _placed(kind: str) -> Column:
    """Start, end, match and what stands before each proposal, in order."""
    none = "cast(array() as array<struct<start:int,stop:int,match:string,near:string>>)"
    found, gaps = f"{kind}_found", f"slice({kind}_between, 1, size({kind}_found))"
    starts = _running("transform(pairs, x -> length(x.gap) + length(x.match))", "{} + {}".format)
    spans = f"""zip_with(pairs, {starts}, (x, s) -> struct(
      s + length(x.gap) as start, s + length(x.gap) + length(x.match) as stop, x.match as match,
      right(x.gap, {CONTEXT_WIDTH}) as near))"""
    pairs = f"zip_with({found}, {gaps}, (m, g) -> struct(m as match, g as gap))"
    return F.expr(f"case when size({found}) = 0 then {none} else {_let(pairs, 'pairs', spans)} end")


def _kept(kind: str, spans: Column, least_score: float) -> Column:
    def scored(span: Column) -> Column:
        bonus = F.when(span["near"].rlike(CONTEXT[kind]), CONTEXT_SCORE).otherwise(0.0)
        return F.struct(
            F.lit(kind).alias("kind"),
            span["start"].alias("start"),
            span["stop"].alias("stop"),
            F.least(F.lit(1.0), F.lit(BASE_SCORE[kind]) + bonus).alias("score"),
        )

    found = F.transform(F.filter(spans, lambda x: _valid(kind, x["match"])), scored)
    if kind in BASE_KINDS:
        return found
    return F.filter(found, lambda x: x["score"] >= least_score)


def scan(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_score: float = LEAST_SCORE,
    *more: Column,
) -> DataFrame:
    """(id, text, spans): an array of (kind, start, stop, score), by kind, then start.

    Starts and ends count code points; the end is behind the last.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = df.select(F.col(id_col).alias("id"), text.alias("text"), *more)
    for kind in KINDS:
        matches, there, between = _proposed(kind, F.col("text"))
        found = found.withColumn(f"{kind}_found", matches)
        found = found.withColumn(
            f"{kind}_between", F.when(F.size(f"{kind}_found") > 0, between)
        )
    found = found.withColumns({f"{kind}_spans": _placed(kind) for kind in KINDS})
    every = [_kept(kind, F.col(f"{kind}_spans"), least_score) for kind in KINDS]
    kept = [f"{k}_{x}" for k in KINDS for x in ("found", "between", "spans")]
    return found.withColumn("spans", F.concat(*every)).drop(*kept)


def joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ","
    )


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, a digest of their spans, all spans, each one's score, and the highest."""
    found = scan(df, id_col, text_col).drop("text")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        F.col("id").alias(id_col),
        *[count(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda x: F.format_number(x["score"], 2)), ",").alias("scores"),
        F.coalesce(F.array_max(F.transform("spans", lambda x: x["score"])), F.lit(0.0)).alias("max_score"),
    )


def redacted(text: str, spans: str) -> Column:
    """The text with ``<KIND>`` in place of each span; of overlapping ones the first stands.

    Texts are cut into pieces of ``PIECE`` characters, so that what stands between two spans is
    found without going through the text from its beginning.
    """
    def between(start: str, stop: str) -> str:
        first, last = f"({start} div {PIECE})", f"({stop} div {PIECE})"
        near = f"array_join(slice(pieces, cast({first} + 1 as int), cast({last} - {first} + 1 as int)), '')"
        return f"substring({near}, cast({start} % {PIECE} + 1 as int), {stop} - {start})"

    # a span stands if it begins where all before it have ended
    ended = _running("transform(marked, x -> x.stop)", "greatest({}, {})".format)
    marks = f"""array_join(zip_with(marked, {ended}, (x, s) ->
      case when x.start >= s then concat({between('s', 'x.start')}, '<', upper(x.kind), '>') else '' end), '')"""
    body = f"concat({marks}, {_let('array_max(transform(marked, x -> x.stop))', 'e', between('e', 'whole'))})"
    in_order = f"array_sort(transform({spans}, x -> struct(x.start as start, x.stop as stop, x.kind as kind)))"
    for name, value in (
        ("whole", f"length({text})"), ("pieces", f"regexp_extract_all({text}, '(?s).{{1,{PIECE}}}', 0)"), ("marked", in_order),
    ):
        body = _let(value, name, body)
    return F.expr(f"case when size({spans}) = 0 then {text} else {body} end")


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their personal data replaced; ``n_chars``, if there, follows."""
    whole = F.struct("*").alias("row")
    found = scan(df, id_col, text_col, LEAST_SCORE, whole)
    new = F.when(F.col("row")[text_col].isNotNull(), redacted("text", "spans"))
    out = found.select("row", new.alias("new"))
    columns = []
    for name in df.columns:
        if name == text_col:
            columns.append(F.col("new").alias(name))
        elif name == "n_chars":
            columns.append(F.coalesce(F.length("new"), F.col("row")[name]).cast(df.schema[name].dataType).alias(name))
        else:
            columns.append(F.col("row")[name].alias(name))
    return out.select(*columns)
