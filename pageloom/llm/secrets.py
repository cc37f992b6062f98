"""Secret scan: candidates by pattern, false positives removed by a random forest, in SQL functions."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import fresh

#: Characters before a candidate that count as its neighbourhood.
NEAR = 24
#: Words of a candidate's neighbourhood that speak for and against a secret.
FOR = "token secret password passwd pwd apikey api_key api-key access_key private auth credential bearer key client_secret"
AGAINST = "sha commit md5 checksum digest hash uuid guid etag revision integrity phone card isbn build version"
#: Words that make up identifiers and prose, for the share of a candidate they cover.
DICTIONARY = "the and for that with this from have tion ing ent ation error value index name file path user data test config service module version package example function return public static string number length object array token secret password key und der die das les des que para con ción mente"
_CORE = "[A-Za-z0-9_+./-]"
_VALUE = r"""[^\s"'`<>,;&|(){}\[\]\\]"""
#: A candidate is a value of LEAST or more characters after a word of FOR and an assignment, a quotation
#: mark or a space, or anywhere a run of LONG or more characters of the alphabets of tokens and base64.
LEAST, LONG = 4, 16
TOKEN = (
    rf"""(?<=[:=>\s"'`])(?={_VALUE}{{{LEAST}}})(?<=(?i:{'|'.join(FOR.split())})[A-Za-z_]{{0,8}}["'`]?\s{{0,2}}(?:[:=]{{1,2}}>?|is)?\s{{0,2}}["'`]?){_VALUE}{{{LEAST},}}(?<![.!?:])"""
    rf"""|(?<!{_CORE}){_CORE}{{{LONG - 1},}}[A-Za-z0-9_+/-]={{0,2}}"""
)
MARK = "[SECRET]"
NAMES = ["length", "switches", "digits", "capitals", "spread", "dictionary", "path", "for", "against", "quoted"]


def features(secret: Column, before: Column) -> list[Column]:
    """NAMES in order: all from the candidate and the text right before it."""
    n = F.length(secret).cast("double")
    cover = F.regexp_replace(F.lower(secret), "|".join(sorted(DICTIONARY.split(), key=lambda w: (-len(w), w))), "")
    near = F.lower(before)
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(secret, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
    return [
        n,
        F.length(kinds) / n,
        F.length(F.regexp_replace(secret, "[^0-9]", "")) / n,
        F.length(F.regexp_replace(secret, "[^A-Z]", "")) / n,
        F.size(F.array_distinct(F.split(secret, ""))) / F.least(n, F.lit(40.0)),
        1 - F.length(cover) / n,
        F.when(near.rlike(r"(://|[\\/])\S*$") | secret.rlike(r"^[./~\-]|://|\.(com|org|net|html?|js|py|png)\b"), 1.0).otherwise(0.0),
        F.when(near.rlike(f"({'|'.join(FOR.split())})[a-z_]*\\W{{0,6}}$"), 1.0).otherwise(0.0),
        F.when(near.rlike(f"\\b({'|'.join(AGAINST.split())})\\W{{0,6}}[a-z0-9]{{0,4}}\\W?$"), 1.0).otherwise(0.0),
        F.when(near.rlike("[\"'`=:]\\s?$"), 1.0).otherwise(0.0),
    ]


def labelled_findings(each: int = 300, seed: int = 11) -> list[tuple[str, str, int]]:
    """(before, candidate, label): a bounded, reproducible set of findings of known origin.

    Secrets are random strings of the usual alphabets in an assignment, short passwords and long
    signed tokens among them, and base64 keys; false findings are digests and ids named as such,
    numbers, paths, host names, identifiers, plain words after a secret word, long words and rulers.
    """
    rng = random.Random(seed)
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda: rng.choice(DICTIONARY.split())
    text = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    prose = lambda: " ".join(word() for _ in range(3))
    out = []
    for _ in range(each):
        name = rng.choice(FOR.split())
        out.append((f"{prose()} {name}{rng.choice([' = ', '=', ': ', ' '])}{rng.choice(['', chr(34)])}", text(rng.choice([hexa, alnum, alnum + "+_-"]), rng.choice([20, 24, 32, 40, 48, 64])), 1))
        out.append((f"{prose()} ", rng.choice(["ghp_", "AKIA", "xoxb-", "sk_live_"]) + text(alnum, rng.choice([24, 32, 36])), 1))
        out.append((f"{prose()} {rng.choice(AGAINST.split())}{rng.choice([' ', ': ', '='])}", text(hexa, rng.choice([32, 40, 64])), 0))
        out.append((f"{prose()} {rng.choice(['', 'card ', 'phone '])}", text("0123456789", rng.randint(16, 20)), 0))
        out.append((f"see https://{word()}.org/{word()}/", "-".join(word() for _ in range(5)) + ".html", 0))
        out.append((f"{prose()} ", "_".join(word() for _ in range(rng.randint(4, 6))), 0))
        out.append((f"{prose()} ", text("abcdefghilmnoprstu", rng.randint(16, 30)), 0))
        out.append((f"{prose()} ", text("ABCDEFGHILMNOPRSTU", rng.randint(16, 30)), 0))
        out.append((f"{prose()} {rng.choice(['', 'password '])}", rng.choice("-=._") * rng.randint(16, 60), 0))
    base64, letters = alnum + "+/", alnum[:52]
    camel = lambda n: "".join(word().replace(" ", "").capitalize() for _ in range(n))
    for _ in range(each):
        name, quote = rng.choice(FOR.split()), rng.choice(["", chr(34)])
        given = f"{prose()} {name}{rng.choice([' = ', '=', ': ', ':', ' '])}{quote}"
        named = f"{prose()} {name}{rng.choice([' = ', '=', ': ', ':'])}{quote}"
        key = rng.choice(["", "", "", "", "/"]) + text(base64, rng.choice([27, 32, 40, 43, 64, 86])) + rng.choice(["", "=", "=="])
        out.append((rng.choice([given, given, f"{prose()} "]), key, 1))
        out.append((given, text(letters, rng.choice([16, 20, 24, 32, 40])), 1))
        out.append((rng.choice([given, f"{prose()} "]), f"eyJ{text(alnum, rng.randint(17, 40))}.eyJ{text(alnum + '_-', rng.randint(60, 1200))}.{text(alnum + '_-', rng.choice([43, 86, 342]))}", 1))
        out.append((rng.choice([given, named, named]), text(alnum + rng.choice(["", "!#$%*+?@^_-"]), rng.randint(6, 15)), 1))
        out.append((named, rng.choice([camel(1), word().replace(" ", ""), text("abcdefghijklmnopqrstuvwxyz", 6)])[:8] + text("0123456789", rng.randint(1, 4)) + rng.choice(["", "!", "#", "$"]), 1))
        out.append((f"{prose()} {name}{rng.choice([' ', ' ', ': ', ' = ', ' is '])}", "".join(word().replace(" ", "") for _ in range(rng.randint(1, 3))) + rng.choice(["", "", "s"]), 0))
        out.append((f"{prose()} {name} ", text("abcdefghilmnoprstu", rng.randint(4, 15)), 0))
        out.append((f"{prose()} ", rng.choice(["", "/", "./", "//"]) + "/".join(rng.choice([word(), word(), camel(1), text("0123456789", rng.randint(1, 4))]).replace(" ", "") for _ in range(rng.randint(4, 9))) + rng.choice(["", "/", ".py", ".txt"]), 0))
        out.append((f"{prose()} ", rng.choice([camel(rng.randint(4, 7)), text("abcdefghilmnoprstu", rng.randint(6, 12)).capitalize() + "/" + text("abcdefghilmnoprstu", rng.randint(6, 12))]), 0))
        out.append((f"{prose()} integrity={chr(34)}", f"sha{rng.choice(['256', '384', '512'])}-" + text(base64, rng.choice([43, 64, 86])) + rng.choice(["", "=", "=="]), 0))
    return [(b[-NEAR:], c, y) for b, c, y in out]


def _gini(ys: list[int]) -> float:
    p = sum(ys) / len(ys)
    return len(ys) * p * (1 - p)


def _tree(rows: list[tuple[tuple[float, ...], int]], rng: random.Random, depth: int) -> float | tuple:
    """A probability, or (feature, limit, tree up to the limit, tree above)."""
    ys = [y for _, y in rows]
    if depth == 0 or len(rows) < 6 or len(set(ys)) == 1:
        return sum(ys) / len(ys)
    best = None
    for f in rng.sample(range(len(NAMES)), math.isqrt(len(NAMES)) + 1):
        values = sorted({x[f] for x, _ in rows})
        for v in rng.sample(values[:-1], min(10, len(values) - 1)):
            low, high = [y for x, y in rows if x[f] <= v], [y for x, y in rows if x[f] > v]
            cost = _gini(low) + _gini(high)
            if best is None or cost < best[0]:
                best = (cost, f, v)
    if best is None:
        return sum(ys) / len(ys)
    _, f, v = best
    return f, v, _tree([r for r in rows if r[0][f] <= v], rng, depth - 1), _tree([r for r in rows if r[0][f] > v], rng, depth - 1)


def forest(rows: list[tuple[tuple[float, ...], int]], trees: int = 15, depth: int = 6, seed: int = 5) -> list:
    """Trees on bootstrap samples, each split over a random subset of the features."""
    rng = random.Random(seed)
    return [_tree(rng.choices(rows, k=len(rows)), rng, depth) for _ in range(trees)]


def probability(trees: list, columns: list[str]) -> Column:
    """The mean of the trees as one expression of nested conditions."""

    def said(t) -> str:
        return repr(float(t)) + "D" if isinstance(t, float) else f"if({columns[t[0]]} <= {float(t[1])!r}D, {said(t[2])}, {said(t[3])})"

    return F.expr(f"({' + '.join(said(t) for t in trees)}) / {len(trees)}D")


def train(spark, each: int = 300) -> list:
    """A forest from labelled_findings(each), whose number is bounded by that parameter."""
    rows = spark.createDataFrame(labelled_findings(each), "before string, secret string, y int")
    got = rows.select(*[f.cast("double").alias(n) for n, f in zip(NAMES, features(F.col("secret"), F.col("before")))], "y").collect()
    return forest([(tuple(r)[:-1], r["y"]) for r in got])


def _scored(docs: DataFrame, each: int) -> DataFrame:
    """doc_id, k (hash of the text), secret and the highest score of its places in the text."""
    trees = train(docs.sparkSession, each)
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    found = text.select("doc_id", "t", F.regexp_extract_all("t", F.lit(TOKEN), F.lit(0)).alias("all")).where(F.size("all") > 0)
    found = found.select("doc_id", F.xxhash64("t").alias("k"), "all", F.split("t", TOKEN, -1).alias("between"))
    # a candidate and the text before it are 8 characters or more, so NEAR / 8 of them reach far enough
    before = f"right(array_join(transform(sequence(greatest(0, i - {NEAR // 8}), i), j -> concat(right(between[j], {NEAR}), if(j < i, right(all[j], {NEAR}), ''))), ''), {NEAR})"
    found = found.select("doc_id", "k", F.explode(F.expr(f"array_distinct(transform(all, (s, i) -> struct(s as secret, {before} as before)))")).alias("f"))
    cols = [f"x.{n}" for n in NAMES]
    held = F.struct(*[f.cast("double").alias(n) for n, f in zip(NAMES, features(F.col("f.secret"), F.col("f.before")))])
    # a generator of one row keeps the optimizer from copying the features into each node of each tree
    found = found.select("doc_id", "k", F.col("f.secret").alias("secret"), F.explode(F.array(held)).alias("x"))
    return found.select("doc_id", "k", "secret", probability(trees, cols).alias("score")).groupBy("doc_id", "k", "secret").agg(F.max("score").alias("score"))


def findings(docs: DataFrame, threshold: float = 0.5, each: int = 300) -> DataFrame:
    """doc_id, secret, sha256 of it, score and is_secret of each distinct finding of a text.

    Candidates come from the whole text by one pattern; the forest scores length, character
    transitions, dictionary coverage, path and neighbouring words. Null and empty texts have no
    findings, an empty table none. Equal findings in one text count once: each place is judged by
    its own neighbourhood and the highest score holds, also over rows that repeat an id; rows with
    a null id count as one document. Columns other than doc_id and text don't matter.
    """
    found = _scored(docs, each).groupBy("doc_id", "secret").agg(F.max("score").alias("score"))
    return found.select("doc_id", "secret", F.sha2("secret", 256).alias("secret_sha256"), "score", (F.col("score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, threshold: float = 0.5, each: int = 300) -> DataFrame:
    """docs with each found secret replaced by MARK in text; all rows stay, all columns as they were.

    n_chars, where there is one, follows the new text. Secrets are replaced longest first; those under
    LONG characters only where they are no part of a longer word. A row loses the secrets of its own
    text only, also where ids repeat or are null; null and empty texts stay; an empty table stays empty.
    """
    one, two, bad = (fresh(docs, n) for n in ("secret_id", "secret_text", "secrets"))
    found = _scored(docs, each).where(F.col("score") >= threshold).groupBy(F.col("doc_id").alias(one), F.col("k").alias(two))
    found = found.agg(F.sort_array(F.collect_set(F.struct(F.length("secret").alias("n"), "secret")), asc=False).alias(bad))
    alone = r"concat('(?<![A-Za-z0-9_])\\Q', s.secret, '\\E(?![A-Za-z0-9_])')"
    clean = F.expr(f"aggregate(`{bad}`, text, (t, s) -> if(s.n >= {LONG}, replace(t, s.secret, '{MARK}'), regexp_replace(t, {alone}, '{MARK}')))")
    own = docs["doc_id"].eqNullSafe(F.col(one)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(two))
    out = docs.join(found, own, "left").withColumn("text", F.when(F.col(bad).isNull(), F.col("text")).otherwise(clean))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(bad).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint")))
    return out.select(*docs.columns)
