"""Secret scans that link the parts of a credential, in DataFrame functions only.

Every kind of part is matched by the JVM's regular expressions; the text between the matches of a kind (a split at them)
gives their places as running sums. The parts of a text, weak ones among them, then meet in an interval join within their row:
a sweep over them in order of place carries the nearest identifier, secret and endpoint on either side to each part, which
decides whether any lies within its scope of SCOPE code points. So neither texts nor parts are shuffled, and no row per pair
is made. Assignments, access keys and hex strings are reported as they stand; weak candidates only with their complement in
scope: a long mixed string beside an identifier or an endpoint, an identifier beside a secret, an endpoint beside both.

Defined results: null and empty texts have no spans; each row is scanned on its own, so repeated rows, repeated ids and null
ids give a row each; an empty table gives no rows; other columns are never read unless they are asked for. Very long texts are
scanned whole, in time in proportion to their length and their number of parts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import table

#: Code points that may lie between the parts of one credential.
SCOPE = 200
REDACTED = "[redacted]"
#: Parts that a sweep adds to one array; an array grows by copies, so longer ones are made of several.
SWEEP = 512


def _any_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_ASSIGNED = """["']?\\x20*[:=]\\x20*["']?"""
#: Kinds in order: name, pattern, the group whose length counts (0: all), and its least length. Where a match is a whole run
#: of a class, the pattern itself asks for the length: the same matches, without the short runs that words are full of.
BASE = (
    ("assign", f"(?:{_any_case('password|passwd|secret|token|api_?key')}){_ASSIGNED}([A-Za-z0-9+/_.=-]+)", 1, 6),
    ("access", "AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
)
WEAK = (
    ("ident", f"(?:{_any_case('username|user_name|user_id|login|client_?id|account_?id|access_?id')}){_ASSIGNED}([A-Za-z0-9@._-]+)", 1, 3),
    ("secret", "[A-Za-z0-9+/_-]{32,}", 0, 32),
    ("endpoint", f"(?:{_any_case('https?|ftps?|postgres|postgresql|mysql|mongodb|redis|amqps?')})://[^\\x20\\x09-\\x0D\"'<>]+", 0, 10),
)
KINDS = tuple(k for k, *_ in (*BASE, *WEAK))
#: A long string is a weak secret only with a digit, a capital and a small letter.
MIXED = ("[0-9]", "[A-Z]", "[a-z]")


def _parts(number: int, least: int) -> Column:
    """A kind's matches in order: the length of the text before each, its own, and whether it counts."""
    whole, valued = F.col(f"_whole{number}"), F.col(f"_valued{number}")
    if KINDS[number] == "secret":
        ok = F.transform(whole, lambda m: reduce(Column.__and__, (m.rlike(c) for c in MIXED)))
    else:
        ok = F.transform(valued, lambda m: F.length(m) >= least)
    # the rest of the text behind the last match closes the list of what lies between
    before = F.slice(F.transform(F.col(f"_between{number}"), F.length), F.lit(1), F.size(whole))
    rows = F.arrays_zip(before.alias("before"), F.transform(whole, F.length).alias("own"), ok.alias("ok"))
    return F.transform(rows, lambda r, i: F.struct(F.lit(number).alias("kind"), i.alias("nth"), r["before"].alias("before"), r["own"].alias("own"), r["ok"].alias("ok")))


def _sweep(items: Column, start: Column, told: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What `step` tells of each item of an array, of the type `told`: step(state, item) gives the next state and the telling."""
    none = F.array().cast(f"array<{told}>")

    def one(done: Column, item: Column) -> Column:
        state, tell = step(done["state"], item)
        return F.struct(state.alias("state"), F.array_append(done["out"], tell).alias("out"))

    def some(done: Column, number: Column) -> Column:
        own = F.aggregate(F.slice(items, number * SWEEP + 1, F.lit(SWEEP)), F.struct(done["state"].alias("state"), none.alias("out")), one)
        joined = F.transform(F.array(own), lambda o: F.struct(o["state"].alias("state"), F.array_append(done["out"], o["out"]).alias("out")))
        return F.get(joined, F.lit(0))  # so that the inner sweep runs once

    numbers = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / SWEEP).cast("int"))).otherwise(F.array().cast("array<int>"))
    zero = F.struct(start.alias("state"), F.array().cast(f"array<array<{told}>>").alias("out"))
    return F.aggregate(numbers, zero, some, lambda done: F.flatten(done["out"]))


def scan(docs: DataFrame, keep: list[str], scope: int = SCOPE, linked: bool = True) -> DataFrame:
    """A row for each of `docs`: the struct `row` of the columns `keep`, and `spans`, an array of (start, kind, end) in
    order of place, with the kind's number in KINDS."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = (*BASE, *WEAK) if linked else BASE
    rows = docs.select(F.struct(*keep).alias("row"), text.alias("_text"), *(F.split(text, pattern, -1).alias(f"_between{i}") for i, (_, pattern, _, _) in enumerate(kinds)))
    none = F.array().cast("array<string>")
    rows = rows.select(
        "row",
        *(f"_between{i}" for i in range(len(kinds))),
        *(  # one pass a kind for the many texts without a match
            F.when(F.size(f"_between{i}") > 1, F.regexp_extract_all("_text", F.lit(pattern), F.lit(own))).otherwise(none).alias(f"_{name}{i}")
            for i, (_, pattern, group, _) in enumerate(kinds)
            for name, own in (("whole", 0), ("valued", group))
        ),
    )
    rows = rows.select("row", F.concat(*(_parts(i, least) for i, (_, _, _, least) in enumerate(kinds))).alias("_found"))

    def place(end: Column, part: Column) -> tuple[Column, Column]:
        start = F.when(part["nth"] == 0, F.lit(0).cast("long")).otherwise(end) + part["before"]
        return start + part["own"], F.struct(start.alias("start"), part["kind"].alias("kind"), (start + part["own"]).alias("end"), part["ok"].alias("ok"))

    placed = _sweep(F.col("_found"), F.lit(0).cast("long"), "struct<start:bigint,kind:int,end:bigint,ok:boolean>", place)
    rows = rows.select("row", F.array_sort(placed).alias("_parts"))
    if not linked:
        return rows.select("row", _spans(F.filter("_parts", lambda p: p["ok"])).alias("spans"))
    # the nearest ends behind and starts ahead, of identifiers, secrets, endpoints and of what is reported as it stands
    groups = {"ident": ("access", "ident"), "secret": ("assign", "hex", "secret"), "endpoint": ("endpoint",), "strong": KINDS[: len(BASE)]}
    nearest = "struct<" + ",".join(f"{g}:bigint" for g in groups) + ">"
    nothing = F.struct(*(F.lit(None).cast("long").alias(g) for g in groups))

    def nearer(pick: Callable[..., Column], side: str) -> Callable[[Column, Column], tuple[Column, Column]]:
        def step(state: Column, part: Column) -> tuple[Column, Column]:
            own = {g: part["ok"] & part["kind"].isin(*(KINDS.index(n) for n in names)) for g, names in groups.items()}
            return F.struct(*(pick(state[g], F.when(own[g], part[side])).alias(g) for g in groups)), state

        return step

    rows = rows.select(
        "row",
        "_parts",
        _sweep(F.col("_parts"), nothing, nearest, nearer(F.greatest, "end")).alias("_behind"),
        F.reverse(_sweep(F.reverse("_parts"), nothing, nearest, nearer(F.least, "start"))).alias("_ahead"),
    )

    def told(part: Column, i: Column) -> Column:
        behind, ahead = F.get("_behind", i), F.get("_ahead", i)

        def near(group: str) -> Column:
            return F.coalesce(part["start"] - behind[group] <= scope, F.lit(False)) | F.coalesce(ahead[group] - part["end"] <= scope, F.lit(False))

        covered = F.coalesce(behind["strong"] > part["start"], F.lit(False)) | F.coalesce(ahead["strong"] < part["end"], F.lit(False))
        link = (
            F.when(part["kind"] == KINDS.index("ident"), near("secret"))
            .when(part["kind"] == KINDS.index("secret"), (near("ident") | near("endpoint")) & ~covered)
            .when(part["kind"] == KINDS.index("endpoint"), near("ident") & near("secret"))
        )
        return part["ok"] & ((part["kind"] < len(BASE)) | F.coalesce(link, F.lit(False)))

    return rows.select("row", _spans(F.filter("_parts", told)).alias("spans"))


def _spans(parts: Column) -> Column:
    return F.transform(parts, lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end")))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """The counts of the base kinds, a hash of the base spans, and all spans, beside the kept columns."""
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))

    def count(number: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == number)).cast("long").alias(f"n_{KINDS[number]}")

    counts = list(map(count, range(len(BASE))))
    return scanned.select("row.*", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The same rows and columns with every reported span of the text replaced; rows without spans stay as they are."""
    found = scan(docs, docs.columns, scope)
    text = F.col("row.text")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def replace(done: Column, span: Column) -> Column:
        begin = F.greatest(span["start"], done["at"])
        own = F.substring(text, done["at"].cast("int") + 1, (begin - done["at"]).cast("int"))
        more = F.when(span["end"] > done["at"], F.concat(done["out"], own, F.when(span["start"] >= done["at"], F.lit(REDACTED)).otherwise(F.lit("")))).otherwise(done["out"])
        return F.struct(F.greatest(span["end"], done["at"]).alias("at"), more.alias("out"))

    cleaned = F.aggregate("spans", start, replace, lambda s: F.concat(s["out"], F.substring(text, s["at"].cast("int") + 1, F.length(text))))
    columns = [F.col(f"row.`{c}`").alias(c) if c != "text" else F.when(F.size("spans") > 0, cleaned).otherwise(text).alias("text") for c in docs.columns]
    return found.select(*columns)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents"), ["doc_id"]))
