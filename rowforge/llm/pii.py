r"""Personal data by weak supervision, in DataFrame functions only.

Base spans (email, ip, card, phone) come from strict patterns and checks and are always
kept. Further candidates (written-out emails, telephone numbers without +, social security numbers, named
secrets, names after a title) come from a wider pattern. Labelers vote for or against
each candidate, base ones included, or abstain: its shape (regex), lists of names and
endings (gazetteer), the words before it (context), and its check digits or make-up. An
expectation-maximisation fit of the labelers' reliabilities turns votes into
probabilities; these train a logistic span classifier over the candidates' features, and
candidates it gives 0.5 or more that meet no base span are added.

Votes and features are discrete, so both fits read a table of distinct patterns
with counts (at most 3^4 votes x the features' values), folded into one row of arrays; their
iterations are higher-order functions over it. Patterns match from left to right in time linear in the
text: runs are possessive, and a match begins at the start of a run or where the last one ended.

Defined cases: a null text is empty and has no spans; texts without candidates add
nothing; with no candidate anywhere the fit is the prior; spans of one start are in the
order of KINDS; repeated rows get the same spans; input columns named base, wide or spans are replaced; positions count code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that every match passes.
GUARD = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Default gazetteers: titles, words that name a secret, top-level endings, and given names. Longer lists are parameters of find_pii.
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Sir", "Mme", "Mlle", "Herr", "Frau", "Sr", "Sra", "Srta", "Don", "Doña", "Sig", "Signora"]
SECRETS = ["token", "secret", "password", "passwd", "passphrase", "api_key", "apikey", "api-key", "access_key", "access-key", "auth_key", "private_key", "secret_key", "client_secret", "bearer"]
ENDINGS = "com org net edu gov mil int io ai app dev info biz eu uk us ca au nz ie de at ch fr be nl lu es pt it gr pl cz sk hu ro bg hr si rs ua ru by lt lv ee fi se no dk is tr il ae sa eg ma tn za ng ke in pk bd lk cn hk tw jp kr sg my th vn ph id br ar cl co mx pe ve uy cu".split()
NAMES = (
    "james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen christopher lisa daniel nancy matthew betty anthony margaret mark sandra donald ashley steven kimberly paul emily andrew donna joshua michelle kenneth carol kevin amanda brian melissa george deborah "
    "anna laura julia maria peter hans petra klaus ursula wolfgang monika jürgen sabine stefan andrea heike uwe birgit dieter helga "
    "pierre marie jean claire jacques nathalie michel isabelle philippe sylvie alain catherine françois martine nicolas céline luc camille antoine sophie "
    "carlos carmen josé ana antonio isabel manuel dolores francisco pilar javier cristina luis sofia miguel lucía pedro elena rafael rosa alejandro marta fernando teresa"
).split()
CUES = ["phone", "tel", "call", "mobile", "fax", "contact", "mail", "email", "write to", "ssn", "social security", "token", "secret", "password", "key", "dear", "by", "from", "name", "regards", "signed", "téléphone", "telefon", "teléfono", "courriel", "correo"]
#: Most entries of a gazetteer: it is a literal of the plan.
GAZETTEER = 20_000
AGAINST = ["version", "release", "isbn", "issn", "page", "figure", "table", "section", "chapter", "eq", "doi", "rfc"]
WIDE = {
    "written_email": r"(?:\G|(?<![\p{L}\p{M}0-9._%+-]))[\p{L}\p{M}0-9._%+-]++\x20?[\[({]at[\])}]\x20?[A-Za-z0-9-]++(?:(?:\x20?[\[({]dot[\])}]\x20?|\.)[A-Za-z0-9-]++)++",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?i:" + "|".join(SECRETS) + r")\x20?[=:]\x20?[\"']?[0-9A-Za-z_-]{16,}+[\"']?",
    "name": r"(?<!\p{L})(?:" + "|".join(TITLES) + r")\.?\x20\p{Lu}[\p{L}\p{M}'’-]++(?:\x20\p{Lu}[\p{L}\p{M}'’-]++)*+",
}
KINDS = [*BASE, *WIDE]
WIDE_PATTERN = "|".join(f"(?:{p})" for p in WIDE.values())
WIDE_GUARD = r"[\[({]at[\])}]|[0-9]{3}\)?[\x20.-][0-9]{2,3}[\x20.-][0-9]{4}|[=:]\x20?[\"']?[0-9A-Za-z_-]{16}|(?:" + "|".join(TITLES) + r")\.?\x20\p{Lu}"
LABELERS = ["shape", "gazetteer", "context", "makeup"]
ROUNDS, STEPS, RATE, SMOOTH = 40, 150, 1.0, 1.0
CONTEXT = 32
#: Matches folded at once; keeps the fold's cost linear in their number.
FOLD = 256


def _barrier(df: DataFrame, **cols: Column) -> DataFrame:
    """df with new columns that later expressions read as values rather than compute anew."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def _spans(pieces: str, matches: str) -> Column:
    """(start, end, m, before) of each match, from what a split leaves and what it takes out."""
    item = "array<struct<start:bigint,end:bigint,m:string,before:string>>"

    def block(k: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            piece, m = F.element_at(pieces, i), F.element_at(matches, i)
            start = s["pos"] + F.length(piece)
            end = start + F.length(m)
            one = F.struct(start.alias("start"), end.alias("end"), m.alias("m"), F.right(piece, F.lit(CONTEXT)).alias("before"))
            return F.struct(end.alias("pos"), F.concat(s["items"], F.array(one)).alias("items"))

        first = k * FOLD + 1
        return F.aggregate(F.sequence(first, F.least(F.size(matches), first + FOLD - 1)), F.struct(F.lit(0).cast("bigint").alias("pos"), F.expr(f"cast(array() as {item})").alias("items")), step)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / FOLD).cast("int")), block)
    ends = F.aggregate(blocks, F.array(F.lit(0).cast("bigint")), lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + b["pos"])))
    moved = F.zip_with(blocks, F.slice(ends, 1, F.size(ends) - 1), lambda b, o: F.transform(b["items"], lambda x: F.struct((x["start"] + o).alias("start"), (x["end"] + o).alias("end"), x["m"].alias("m"), x["before"].alias("before"))))
    return F.when(F.size(matches) > 0, F.flatten(moved)).otherwise(F.expr(f"cast(array() as {item})"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    at = lambda i: F.substr(d, F.length(d) - i, F.lit(1)).cast("int")  # noqa: E731  from the right, the first is 0
    doubled = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    total = F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, doubled(at(i))).otherwise(at(i)))
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _any(text: Column, words: list[str], whole: bool = True) -> Column:
    return F.lower(text).rlike((r"\b" if whole else "") + "(?:" + "|".join(words) + ")" + (r"\b" if whole else ""))


def _kind(m: Column) -> Column:
    """Which of the wider kinds a match is."""
    out = F.lit("name")
    for k in reversed([k for k in WIDE if k != "name"]):
        out = F.when(m.rlike("^(?:" + WIDE[k].replace("(?:\\G|(?<![\\p{L}\\p{M}0-9._%+-]))", "").replace("(?<![0-9-])", "").replace("(?<![0-9+(.-])", "").replace("(?![0-9-])", "").replace("(?![0-9])", "") + ")$"), F.lit(k)).otherwise(out)
    return out


def _listed(m: Column, words: list[str]) -> Column:
    """Whether a word of m is one of a list."""
    return F.exists(F.split(F.lower(m), r"[^\p{L}]+"), lambda w: w.isin(words))


def _candidate(kind: Column, x: Column, valid: Column, base: bool, names: list[str], endings: list[str]) -> Column:
    """A candidate with its votes (1, 0, -1 by labeler) and its features."""
    m, before = x["m"], x["before"]
    d = F.length(_digits(m))
    shape = F.when(F.lit(base) | kind.isin("ssn", "written_email"), 1).when(kind == "secret", F.when(m.rlike("[=:][^0-9]{0,24}[0-9]"), 1).otherwise(-1)).when(kind == "local_phone", F.when(m.rlike(r"^\(?[0-9]{3}\)?([\x20.-])[0-9]{3}\1[0-9]{4}$|^\([0-9]{3}\)\x20[0-9]{3}-[0-9]{4}$"), 1).otherwise(-1)).otherwise(0)
    gazetteer = F.when(kind.isin("email", "written_email"), F.when(F.lower(F.regexp_extract(m, "[A-Za-z]+$", 0)).isin(endings), 1).otherwise(-1)).when(kind == "name", F.when(_listed(m, names), 1).otherwise(0)).otherwise(0)
    context = F.when(_any(before, AGAINST), -1).when(_any(before, CUES), 1).otherwise(0)
    makeup = (
        F.when(kind == "secret", F.when(m.rlike("[=:].*[0-9]") & m.rlike("[=:].*[A-Za-z]"), 1).otherwise(-1))
        .when(kind == "ssn", F.when(m.rlike("^(?!000|666|9)"), 1).otherwise(-1))
        .when(kind == "local_phone", F.when(m.rlike(r"^\(?[2-9][0-9]{2}\)?.[2-9]"), 1).otherwise(-1))
        .when(kind.isin("ip", "card", "phone"), F.when(valid, 1).otherwise(-1))
        .otherwise(0)
    )
    features = F.array(*[F.when(kind == k, 1).otherwise(0) for k in KINDS], F.when(shape > 0, 1).otherwise(0), F.when(gazetteer > 0, 1).otherwise(0), F.when(context > 0, 1).otherwise(0), F.when(context < 0, 1).otherwise(0), F.when(makeup > 0, 1).otherwise(0), F.when(makeup < 0, 1).otherwise(0), F.when(d >= 7, 1).otherwise(0), F.lit(1))
    return F.struct(kind.alias("kind"), x["start"].alias("start"), x["end"].alias("end"), valid.alias("valid"), F.array(shape, gazetteer, context, makeup).alias("votes"), features.alias("features"))


def candidates(documents: DataFrame, text_col: str = "text", keep: list[str] | None = None, names: list[str] | None = None, endings: list[str] | None = None) -> DataFrame:
    """documents with `base` and `wide`: arrays of candidates."""
    names, endings = ([w.lower() for w in (own if given is None else given)] for given, own in ((names, NAMES), (endings, ENDINGS)))
    if max(len(names), len(endings)) > GAZETTEER:
        raise ValueError(f"a gazetteer holds {GAZETTEER} entries at most")
    kept = [c for c in (documents.columns if keep is None else keep) if c not in ("base", "wide", "spans")]
    df = documents.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__t"))
    none = F.expr("cast(array() as array<string>)")
    t = F.col("__t")
    pats = {**BASE, "wide": WIDE_PATTERN}
    guard = {k: F.contains(t, F.lit("@")) if k == "email" else t.rlike(g) for k, g in {**GUARD, "wide": WIDE_GUARD}.items()}
    df = _barrier(df, **{f"__m_{k}": F.when(guard[k], F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(none) for k, p in pats.items()})
    df = _barrier(df, **{f"__p_{k}": F.when(F.size(f"__m_{k}") > 0, F.split(t, p, -1)).otherwise(none) for k, p in pats.items()})
    df = _barrier(df.drop("__t"), **{f"__s_{k}": _spans(f"__p_{k}", f"__m_{k}") for k in pats}).drop(*[f"__{a}_{k}" for a in "mp" for k in pats])

    def strict(kind: str):  # a function of one argument: Spark counts a lambda's
        return lambda x: _candidate(F.lit(kind), x, _valid(kind, x["m"]), True, names, endings)

    base = F.concat(*[F.transform(f"__s_{k}", strict(k)) for k in BASE])
    wide = F.transform("__s_wide", lambda x: _candidate(_kind(x["m"]), x, F.lit(True), False, names, endings))
    return df.select(*kept, base.alias("base"), wide.alias("wide"))


def reliabilities(votes: DataFrame) -> DataFrame:
    """One row (prior, yes, no): the fit of the labelers from (votes, n); yes and no hold P(vote for | true) and P(vote for | false)."""
    n = len(LABELERS)
    start = F.struct(F.lit(0.5).alias("prior"), F.array(*[F.lit(0.8)] * n).alias("yes"), F.array(*[F.lit(0.4)] * n).alias("no"))
    rows = votes.agg(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n"))).alias("rows"))

    def step(s: Column, _: Column) -> Column:
        seen = F.transform("rows", lambda r: F.struct(r["votes"].alias("votes"), r["n"].alias("n"), posterior(r["votes"], s).alias("p")))
        total = F.aggregate("rows", F.lit(0.0), lambda a, r: a + r["n"])

        def share(i: int, truth: bool) -> Column:
            w = lambda r: r["n"] * (r["p"] if truth else 1 - r["p"])
            cast_ = F.aggregate(seen, F.lit(0.0), lambda a, r: a + F.when(r["votes"][i] != 0, w(r)).otherwise(0.0))
            for_ = F.aggregate(seen, F.lit(0.0), lambda a, r: a + F.when(r["votes"][i] > 0, w(r)).otherwise(0.0))
            return (for_ + SMOOTH * (0.8 if truth else 0.4)) / (cast_ + SMOOTH)

        prior = (F.aggregate(seen, F.lit(0.0), lambda a, r: a + r["n"] * r["p"]) + 1) / (total + 2)
        return F.struct(prior.alias("prior"), F.array(*[share(i, True) for i in range(n)]).alias("yes"), F.array(*[share(i, False) for i in range(n)]).alias("no"))

    return rows.select(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step).alias("s")).select("s.*")


def posterior(votes: Column, s: Column) -> Column:
    """P(true | votes) under the fit s."""
    one = lambda v, q: F.when(v > 0, q).when(v < 0, 1 - q).otherwise(1.0)
    true, false = s["prior"], 1 - s["prior"]
    for i in range(len(LABELERS)):
        true, false = true * one(votes[i], s["yes"][i]), false * one(votes[i], s["no"][i])
    return true / (true + false)


def classifier(examples: DataFrame) -> DataFrame:
    """One row (w): logistic weights fitted to (features, p, n) by gradient steps."""
    rows = examples.agg(F.collect_list(F.struct("features", "p", F.col("n").cast("double").alias("n"))).alias("rows"), F.sum("n").cast("double").alias("total"))
    size = len(KINDS) + 8
    start = F.array_repeat(F.lit(0.0), size)

    def step(w: Column, _: Column) -> Column:
        def pull(g: Column, r: Column) -> Column:
            off = r["n"] * (r["p"] - _logistic(r["features"], w))
            return F.zip_with(g, r["features"], lambda a, x: a + x * off)

        grad = F.aggregate("rows", F.array_repeat(F.lit(0.0), size), pull)
        return F.zip_with(w, grad, lambda a, g: a + RATE * 4 * (g / F.greatest(F.col("total"), F.lit(1.0)) - 0.0005 * a))

    return rows.select(F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step), start).alias("w"))


def _logistic(features: Column, w: Column) -> Column:
    z = F.aggregate(F.zip_with(features, w, lambda x, y: x * y), F.lit(0.0), lambda a, b: a + b)
    return 1 / (1 + F.exp(-z))


def find_pii(documents: DataFrame, text_col: str = "text", keep: list[str] | None = None, names: list[str] | None = None, endings: list[str] | None = None) -> DataFrame:
    """documents with base and spans: arrays of (kind, start, end), spans with the classifier's score.

    names, endings: gazetteers to use instead of the default ones.
    """
    found = C.cut(candidates(documents, text_col, keep, names, endings), "pii-candidates")
    every = found.select(F.explode(F.concat("base", "wide")).alias("c")).select("c.votes", "c.features")
    counts = C.cut(every.groupBy("votes", "features").agg(F.count("*").alias("n")), "pii-patterns")
    fit = reliabilities(counts.groupBy("votes").agg(F.sum("n").alias("n"))).first()  # one row of numbers
    s = {"prior": F.lit(fit["prior"]), "yes": [F.lit(x) for x in fit["yes"]], "no": [F.lit(x) for x in fit["no"]]}
    examples = C.cut(counts.select("features", posterior(F.col("votes"), s).alias("p"), "n"), "pii-examples")
    w = F.array(*[F.lit(x) for x in classifier(examples).first()["w"]])
    order = F.array(*map(F.lit, KINDS))
    plain = lambda c: F.struct(c["start"].alias("start"), F.array_position(order, c["kind"]).alias("k"), c["end"].alias("end"), c["kind"].alias("kind"), _logistic(c["features"], w).alias("score"))
    df = _barrier(found, __base=F.array_sort(F.transform(F.filter("base", lambda c: c["valid"]), plain)), __wide=F.transform("wide", plain))
    free = F.filter("__wide", lambda c: (c["score"] >= 0.5) & ~F.exists("__base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    named = lambda a: F.transform(a, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["score"].alias("score")))
    kept = [c for c in found.columns if c not in ("base", "wide")]
    return df.select(*kept, named(F.col("__base")).alias("base"), named(F.array_sort(F.concat("__base", free))).alias("spans"))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")


def op7(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda c: c["kind"] == kind)).cast("long").alias(f"n_{kind}")

    n = [count(k) for k in BASE]
    return found.select("doc_id", *n, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
