"""Personal data by weak supervision, in DataFrame functions only.

* Candidates.  Patterns find spans of each kind: the strict ones (`BASE`: e-mail addresses, IP addresses, card and phone numbers, which
  are always reported if they pass their check) and looser ones (`LOOSE`: e-mail addresses that are spelt out, phone numbers without a
  country code, social security numbers, names).  A loose span that overlaps a strict one, or a loose one that begins before it, is none.
* Labelers.  Five of them vote yes, no or nothing on each candidate: its form, its check (digits, blocks, top domain), a
  gazetteer (domains, calling codes, card issuers, address blocks, first names), the words before it, its borders.
* Reliabilities.  What each vote of each labeler is worth, and how common true spans are, is estimated for each kind by
  expectation-maximisation over the counts of vote patterns: at most 3 ** 5 a kind, so that the whole estimation
  is one row of arrays.  Weak prior counts say that labelers are right more often than wrong.
* Classifier.  A naive Bayes model of votes and of forms (digits, separators, length, neighbours) is trained on all candidates, each
  weighted by its estimated probability.  A loose span is reported where the model gives it at least `least`.

Each strict pattern gives what the pattern of its definition gives, leftmost and not overlapping, but takes linear time on any text:
runs of letters are taken at once, and from their beginning (or from the end of the last match).

A text is read once.  Its candidates, with a few characters on both sides, are shuffled by a number of the row, since
places are running sums of lengths; models travel as some hundred numbers.  A row's spans meet in one task, as they
do in its result; nothing else is gathered.

Defined results: a null text counts as empty and has no spans; rows of one doc_id are judged each by itself; equal texts have equal spans; columns
of docs other than doc_id and text are not read; an empty table gives an empty result.  Reruns agree: counts and weights are summed as whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import cluster
from .fingerprints import let

KINDS = ("email", "ip", "card", "phone", "ssn", "name")
N_BASE = 4
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+(?: at {_LABEL}{{1,63}}+(?: dot {_LABEL}{{1,63}}+){{1,6}}+| ?[\[({{]at[\])}}] ?{_LABEL}{{1,63}}+(?:(?: ?[\[({{]dot[\])}}] ?| dot |\.){_LABEL}{{1,63}}+){{1,6}}+)",
    "phone": r"(?=[(0-9])(?<![\w.,:@+/-])(?![0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]))\(?[0-9]{2,5}\)?(?:[ .-][0-9]{2,5}){1,4}+(?![\w@/-])",
    "ssn": r"(?=[0-9])(?<![\w.,:@+/-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\w@/-])",
    "name": r"(?=\p{Lu})(?<![\p{L}\p{N}_])(?!(?:Dear|Mrs?|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señora?) )\p{Lu}\p{Ll}{1,20}+(?: \p{Lu}\p{Ll}{1,20}+){1,2}+(?![\p{L}\p{N}_])",
}

# fixed values of the gazetteer and of the words before a span
TOP_DOMAINS = "com org net edu gov mil int info biz io ai de fr es it nl uk us ca au jp cn br ru ch at be se no dk fi pl pt in eu".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 354 358 359 370 371 372 380 385 386 420 421 852 886 971 972".split()
FIRST_NAMES = (
    "james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen daniel nancy matthew lisa anthony betty mark margaret paul "
    "sandra steven ashley andrew emily kevin michelle brian amanda george anna peter maria hans klaus jürgen wolfgang heike sabine monika claudia jean pierre michel marie françoise isabelle sophie nicolas "
    "josé juan carlos luis carmen ana isabel pilar alice bob jane"
).split()
NO_NAMES = "monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december new north south east west the united san saint".split()
CUES = {
    "email": "email e-mail mail contact write address kontakt adresse correo courriel",
    "ip": "ip address host server client login addr adresse",
    "card": "card visa mastercard amex credit debit payment karte kreditkarte carte tarjeta",
    "phone": "phone tel telephone call mobile cell fax contact telefon anruf handy téléphone teléfono móvil llamar appelez",
    "ssn": "ssn social security taxpayer",
    "name": "mr mrs ms dr prof name sincerely signed herr frau mme monsieur madame señor señora dear",
}
NO_CUES = "version order invoice isbn issn page chapter section figure table ref reference serial part article doi build release commit".split()

N_VOTES, N_FEATURES = 5, 5
_BEFORE, _AFTER = 48, 2
#: prior counts of (no, nothing, yes) among false and among true spans
_PRIOR = ((8.0, 5.0, 2.0), (2.0, 5.0, 8.0))


def _pieces(text: Column, kind: str, pattern: str, loose: bool, needs: Column) -> Column:
    """(kind, loose, i, gap, found): what lies before each match, and the match; the last is what lies after all.

    Empty where nothing is found; a text that lacks what each match `needs` is not searched, and one without a match is not split."""

    def told(found: Column) -> Column:
        zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("found"))
        piece = lambda x, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.lit(loose).alias("loose"), i.alias("i"), x["gap"].alias("gap"), x["found"].alias("found"))
        return F.when(F.size(found) > 0, F.transform(zipped, piece)).otherwise(F.array())

    return F.when(needs, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), told)).otherwise(F.array())


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of ASCII digits passes the check: every second digit from the right counts twice, less 9 above 9."""
    at = lambda i: F.ascii(F.substring(F.reverse(digits), i, F.lit(1))) - 48
    worth = lambda i: F.when(i % 2 == 1, at(i)).otherwise(2 * at(i) - F.when(at(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + worth(i)) % 10 == 0


def _valid(kind: Column, found: Column) -> Column:
    """Whether a strict match passes its check."""
    digits = _digits(found)
    part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return (
        F.when(kind == KINDS.index("ip"), found.rlike(rf"^{part}\.{part}\.{part}\.{part}$"))
        .when(kind == KINDS.index("card"), F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False))
        .when(kind == KINDS.index("phone"), F.length(digits).between(9, 15))
        .otherwise(True)
    )


def _one_of(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def _vote(yes: Column, no: Column) -> Column:
    return F.when(F.coalesce(no, F.lit(False)), 0).when(F.coalesce(yes, F.lit(False)), 2).otherwise(1)


def _by_kind(kind: Column, values: dict[str, Column]) -> Column:
    out = F.lit(1)
    for name, value in values.items():
        out = F.when(kind == KINDS.index(name), value).otherwise(out)
    return out


def _votes(kind: Column, loose: Column, found: Column, before: Column, after: Column) -> Column:
    """0 (no), 1 (nothing) or 2 (yes) of each labeler; `before` and `after` are the characters beside the span."""
    digits, none = _digits(found), F.lit(False)
    strict = ~loose
    date = found.rlike(r"^(?:(?:19|20)[0-9]{2}[ .-][0-9]{1,2}[ .-][0-9]{1,2}|[0-9]{1,2}[ .-][0-9]{1,2}[ .-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}[ -](?:19|20)[0-9]{2})$")
    national = found.rlike(r"^(?:\([0-9]{2,5}\)|[0-9]{3})[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}$")
    form = _by_kind(
        kind,
        {
            "email": _vote(strict | found.rlike(r"[\[({]"), none),
            "ip": _vote(strict, found.rlike(r"(?:^|\.)0[0-9]")),
            "card": _vote(found.rlike(r"^(?:[0-9]+|[0-9]{4}(?:[ -][0-9]{4})+|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$"), none),
            "phone": _vote(strict | national, date | (loose & ~national)),
            "ssn": _vote(F.lit(True), none),
            "name": _vote(none, none),
        },
    )
    check = _by_kind(
        kind,
        {
            "email": _vote(found.rlike(r"[A-Za-z]{2,}$"), ~found.rlike(r"[A-Za-z]{2,}$")),
            "ip": _vote(~found.rlike(r"^0*\."), found.rlike(r"^0*\.")),
            "card": _vote(F.lit(True), found.rlike(r"^([0-9])\1+$")),
            "phone": _vote(F.length(digits).between(9, 15), ~F.length(digits).between(7, 15)),
            "ssn": _vote(F.lit(True), digits.rlike(r"^([0-9])\1+$")),
            "name": _vote(none, none),
        },
    )
    first = F.lower(F.substring_index(found, " ", 1))
    known = _by_kind(
        kind,
        {
            "email": _vote(F.lower(found).rlike(rf"[^a-z]{_one_of(TOP_DOMAINS)}$"), none),
            "ip": _vote(none, found.rlike(r"^(?:0*127|0*10|0*0|2(?:2[4-9]|[3-5][0-9]))\.")),
            "card": _vote(digits.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6[05])"), ~digits.rlike("^[2-6]")),
            "phone": _vote(strict & digits.rlike(f"^{_one_of(CALLING_CODES)}"), strict & ~digits.rlike(f"^{_one_of(CALLING_CODES)}")),
            "ssn": _vote(none, none),
            "name": _vote(first.isin(FIRST_NAMES), first.isin(NO_NAMES)),
        },
    )
    words = F.lower(before)
    near = lambda cues: words.rlike(rf"(?:^|[^\p{{L}}]){_one_of(cues)}[^\p{{L}}]{{1,3}}(?:\p{{L}}+[^\p{{L}}]{{1,3}}){{0,2}}$")
    context = _by_kind(kind, {k: _vote(near(c.split()), near(NO_CUES)) for k, c in CUES.items()})
    inside = before.rlike(r"[\p{L}\p{N}_=/@]$") | after.rlike(r"^[\p{L}\p{N}_=/@]")
    borders = _vote((before.rlike(r"[\s(\[{<\"',;:|]$") | (before == "")) & (after.rlike(r"^[\s.)\]}>\"',;:!?|]") | (after == "")), inside)
    return F.array(form, check, known, context, borders)


def _class(piece: Column) -> Column:
    return F.when(piece == "", 0).when(piece == "\n", 1).when(piece.rlike(r"^\s$"), 2).otherwise(3)


def _features(found: Column, before: Column, after: Column) -> Column:
    """Five numbers from 0 to 3: digits, separators, length, and the characters on both sides."""
    n, size = F.length(_digits(found)), F.length(found)
    spaces, marks = F.contains(found, F.lit(" ")), found.rlike("[-.@]")
    return F.array(
        F.when(n == 0, 0).when(n < 9, 1).when(n < 12, 2).otherwise(3),
        spaces.cast("int") + 2 * marks.cast("int"),
        F.when(size <= 10, 0).when(size <= 16, 1).when(size <= 24, 2).otherwise(3),
        _class(F.right(before, F.lit(1))),
        _class(F.left(after, F.lit(1))),
    )


def _slots(votes: Column, features: Column | None = None) -> Column:
    """Numbers of the cells that a candidate's votes (and features) stand for: three for each labeler, then four for each feature."""
    cells = F.transform(votes, lambda v, j: j * 3 + v)
    return cells if features is None else F.concat(cells, F.transform(features, lambda v, j: F.lit(3 * N_VOTES) + j * 4 + v))


def candidates(docs: DataFrame) -> DataFrame:
    """(row, doc_id, kind, loose, start, end, votes, features): the candidates of each text; one row of null kind for each text besides."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digit, spelt = F.col("digit"), F.contains("text", F.lit(" dot ")) | F.contains("text", F.lit("at]")) | F.contains("text", F.lit("at)")) | F.contains("text", F.lit("at}"))
    needs = {"email": F.contains("text", F.lit("@")), "ip": digit, "card": digit, "phone": F.contains("text", F.lit("+"))}
    loosely = {"email": spelt, "phone": digit, "ssn": digit, "name": F.lit(True)}
    pieces = [_pieces(F.col("text"), k, p, False, needs[k]) for k, p in BASE.items()] + [_pieces(F.col("text"), k, p, True, loosely[k]) for k, p in LOOSE.items()]
    one = F.array(F.struct(F.lit(None).cast("int").alias("kind"), F.lit(None).cast("boolean").alias("loose"), F.lit(0).alias("i"), F.lit("").alias("gap"), F.lit(None).cast("string").alias("found")))
    named = docs.select(F.col("doc_id"), F.monotonically_increasing_id().alias("row"), text.alias("text")).withColumn("digit", F.col("text").rlike("[0-9]"))
    pieces = named.select("row", "doc_id", F.explode(F.concat(one, *pieces)).alias("p")).select("row", "doc_id", "p.*")
    pieces = pieces.select(
        "row", "doc_id", "kind", "loose", "i", F.length("gap").alias("gap"), F.right("gap", F.lit(_BEFORE)).alias("before"), F.left("gap", F.lit(_AFTER)).alias("head"), "found"
    )
    along = Window.partitionBy("row", "kind", "loose").orderBy("i")
    size = F.col("gap") + F.coalesce(F.length("found"), F.lit(0))
    placed = pieces.repartition("row").withColumn("start", F.sum(size).over(along) - size + F.col("gap")).withColumn("after", F.lead("head").over(along))
    ends = placed.filter(F.col("kind").isNull()).select(
        "row", "doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("kind", "int"), ("loose", "boolean"), ("start", "long"), ("end", "long"), ("votes", "array<int>"), ("features", "array<int>"))]
    )
    found = placed.filter(F.col("found").isNotNull()).withColumn("end", F.col("start") + F.length("found")).filter(F.col("loose") | _valid(F.col("kind"), F.col("found")))
    # a loose span gives way to strict ones, and to a loose one before it
    by_place = Window.partitionBy("row").orderBy("start", "loose", "kind", "end")
    strict_end, strict_start = F.when(~F.col("loose"), F.col("end")), F.when(~F.col("loose"), F.col("start"))
    clear = (F.coalesce(F.max(strict_end).over(by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) <= F.col("start")) & (
        F.coalesce(F.min(strict_start).over(by_place.rowsBetween(1, Window.unboundedFollowing)), F.lit(1 << 62)) >= F.col("end")
    )
    clear = ~F.col("loose") | (clear & (F.coalesce(F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) <= F.col("start")))
    found = found.withColumn("clear", clear).filter("clear")
    seen = (F.col("kind"), F.col("loose"), F.col("found"), F.col("before"), F.coalesce(F.col("after"), F.lit("")))
    judged_ = found.select("row", "doc_id", "kind", "loose", "start", "end", _votes(*seen).alias("votes"), _features(*seen[2:]).alias("features"))
    # two capitalised words are a candidate only where the gazetteer or the words before speak for them
    told = (F.col("kind") != KINDS.index("name")) | (F.col("votes")[2] == 2) | (F.col("votes")[3] == 2)
    return judged_.filter(told).unionByName(ends)


def _sum(patterns: Column, weight) -> Column:
    return F.aggregate(patterns, F.lit(0.0), lambda s, r: s + weight(r))


def _log_odds(state: Column, slots: Column) -> Column:
    """State: the log-odds of a true span, then what each cell adds to it."""
    return F.aggregate(slots, F.get(state, F.lit(0)), lambda s, k: s + F.get(state, k + 1))


def _probability(log_odds: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-log_odds))


def _reestimated(patterns: Column, state: Column) -> Column:
    """One round: the probability of each vote pattern (n, slots) under `state`, then the state that these give."""

    def maximise(weighted: Column) -> Column:
        true, all_ = _sum(weighted, lambda r: r["n"] * r["p"]), _sum(weighted, lambda r: r["n"].cast("double"))

        def cell(totals: Column, k: Column) -> Column:
            has = lambda r: F.array_contains(r["slots"], k).cast("double") * r["n"]
            yes, both = _sum(weighted, lambda r: has(r) * r["p"]), _sum(weighted, has)
            prior = lambda y: F.element_at(F.array(*[F.lit(x) for x in _PRIOR[y]]), (k % 3 + 1).cast("int"))
            room = sum(_PRIOR[0])
            return F.log((yes + prior(1)) / (totals["true"] + room)) - F.log((both - yes + prior(0)) / (totals["all"] - totals["true"] + room))

        def new(totals: Column) -> Column:
            odds = F.log((totals["true"] + 1.0) / (totals["all"] - totals["true"] + 1.0))
            return F.concat(F.array(odds), F.transform(F.sequence(F.lit(0), F.lit(3 * N_VOTES - 1)), lambda k: cell(totals, k)))

        return F.get(F.transform(F.array(F.struct(true.alias("true"), all_.alias("all"))), new), F.lit(0))

    weighted = F.transform(patterns, lambda r: F.struct(r["n"].alias("n"), r["slots"].alias("slots"), _probability(_log_odds(state, r["slots"])).alias("p")))
    return F.get(F.transform(F.array(weighted), maximise), F.lit(0))


def reliabilities(found: DataFrame, rounds: int = 30) -> dict[int, list[float]]:
    """Of each kind the log-odds of a true span, and what each vote of each labeler adds to it."""
    counts = found.filter("kind is not null").groupBy("kind", _slots(F.col("votes")).alias("slots")).agg(F.count("*").alias("n"))
    rows = counts.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("slots", "n"))).alias("patterns"))
    start = F.array(*[F.lit(x) for x in [0.0] + [v for _ in range(N_VOTES) for v in (-1.4, 0.0, 1.4)]])
    state = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda state, _: _reestimated(F.col("patterns"), state))
    return {r.kind: list(r.state) for r in rows.select("kind", state.alias("state")).collect()}  # a row a kind


def _model(kind: Column, models: dict[int, list[float]]) -> Column:
    """The model of a candidate's kind, as an array."""
    width = max((len(m) for m in models.values()), default=1)
    return F.get(F.lit([models.get(k, [0.0] * width) for k in range(len(KINDS))]), kind) if models else F.lit([0.0])


def classifier(found: DataFrame, states: dict[int, list[float]]) -> dict[int, list[float]]:
    """Naive Bayes over votes and features, trained on every candidate by its estimated probability."""
    chance = F.round(_probability(_log_odds(_model(F.col("kind"), states), _slots(F.col("votes")))) * 1e6).cast("long")
    cells = found.filter("kind is not null").select("kind", chance.alias("p"), F.explode(F.concat(F.array(F.lit(-1)), _slots(F.col("votes"), F.col("features")))).alias("cell"))
    sums = cells.groupBy("kind", "cell").agg(F.sum("p").alias("true"), F.sum(F.lit(1_000_000) - F.col("p")).alias("false"))
    of = {(r.kind, r.cell): (r.true / 1e6, r.false / 1e6) for r in sums.collect()}  # at most 36 a kind
    import math

    models = {}
    for kind in states:
        true, false = of[kind, -1]
        model = [math.log((true + 1) / (false + 1))]
        for cell in range(3 * N_VOTES + 4 * N_FEATURES):
            a, b = of.get((kind, cell), (0.0, 0.0))
            up, down = (_PRIOR[1][cell % 3], _PRIOR[0][cell % 3]) if cell < 3 * N_VOTES else (2.0, 2.0)
            room = sum(_PRIOR[0]) if cell < 3 * N_VOTES else 8.0
            model.append(math.log((a + up) / (true + room)) - math.log((b + down) / (false + room)))
        models[kind] = model
    return models


def judged(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, row, base, spans): arrays of (start, kind, end, score), by start, then kind; base: of the strict patterns.  score: the classifier's."""
    found = cluster.written(candidates(docs), "personal-spans")
    score = _probability(_log_odds(_model(F.col("kind"), classifier(found, reliabilities(found))), _slots(F.col("votes"), F.col("features"))))
    scored = found.withColumn("score", F.when(F.col("kind").isNotNull(), score))
    span = F.struct("start", "kind", "end", "score")
    told = lambda kept: F.array_sort(F.collect_list(F.when(kept, span)))
    is_base = F.col("kind").isNotNull() & ~F.col("loose")
    return scored.groupBy("row").agg(F.first("doc_id").alias("doc_id"), told(is_base).alias("base"), told(is_base | (F.col("score") >= least)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each, joined by commas."""
    name = lambda s: F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def masked(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, text) with every reported span replaced by its kind in angle brackets; of overlapping spans the first one's name stays."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("number"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spans = judged(docs, least).select(F.col("row").alias("number"), "spans")
    piece = lambda text, a, b: F.substring(text, a + 1, b - a)
    step = lambda text: lambda done, s: F.when(s["start"] < done["at"], F.struct(done["out"].alias("out"), F.greatest(done["at"], s["end"]).alias("at"))).otherwise(
        F.struct(F.concat(done["out"], piece(text, done["at"], s["start"]), F.lit("<"), F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"]), F.lit(">")).alias("out"), s["end"].alias("at"))
    )
    done = F.aggregate(F.col("spans"), F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), step(F.col("text")))
    whole = rows.join(spans, "number").withColumn("done", done)
    return whole.select("doc_id", F.concat("done.out", F.substring(F.col("text"), F.col("done.at") + 1, F.length("text"))).alias("text"))
