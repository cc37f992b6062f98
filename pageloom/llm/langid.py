"""Language identification: words first, backing off to shorter and shorter character n-grams."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import held_out, uniform



def _class(*kinds: str) -> str:
    """The characters of the general categories that start with one of `kinds`, as ranges of a character class."""
    inside = [unicodedata.category(chr(c))[0] in kinds for c in range(sys.maxunicode + 1)]
    edges = [c for c in range(len(inside)) if inside[c] != (c > 0 and inside[c - 1])]
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2], [*edges[1::2], sys.maxunicode + 1]))


#: A letter and the letters and combining marks that follow it; digits, other numbers, punctuation and the underscore end a word.
LETTERS = re.compile(f"[{_class('L')}][{_class('L', 'M')}]*")
LONGEST = 5
#: Labelled documents to draw of a rare language.
FLOOR = 100


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Model:
    """Log frequencies by language of known words (order 0) and of n-grams (order 1 to LONGEST).

    The terms of all orders are rows of one matrix; tables map a term to its row.
    """

    def __init__(self, rows: list[tuple[str, int, str, int]], alpha: float = 0.5):
        self.langs = sorted({r[0] for r in rows})
        at = {x: i for i, x in enumerate(self.langs)}
        self.tables: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        blocks = [np.zeros((0, max(1, len(self.langs))))]
        for order, t in enumerate(self.tables):
            own = [r for r in rows if r[1] == order]
            base = sum(map(len, blocks))
            for r in own:
                t.setdefault(r[2], base + len(t))
            n = np.zeros((len(t), max(1, len(self.langs))))
            for lang, _, gram, k in own:
                n[t[gram] - base, at[lang]] += k
            blocks.append(np.log(n + alpha) - np.log(n.sum(0) + alpha * max(1, len(t))))
        self.matrix = np.concatenate(blocks)

    def terms(self, word: str) -> list[int]:
        """Rows that score the word: its own if it is known, else those of its longest known n-grams."""
        known = self.tables[0].get(word)
        if known is not None:
            return [known]
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            t = self.tables[n]
            found = [t[g] for g in grams(word, n) if g in t]
            if found:
                return found
        return []

    def words(self, words: list[str]) -> np.ndarray:
        """A row of log frequencies for each word: the mean of its terms, zeros without any."""
        terms = [self.terms(w) for w in words]
        size = np.fromiter(map(len, terms), int, len(terms))
        out = np.zeros((len(words), self.matrix.shape[1]))
        some = size > 0
        if some.any():
            flat = self.matrix[[i for x in terms for i in x]]
            first = np.concatenate([[0], np.cumsum(size[some])[:-1]])
            out[some] = np.add.reduceat(flat, first) / size[some, None]
        return out

    def scorer(self, kept: int = 300_000):
        """A function from text to (language, posterior).

        Each token between white space is scored once, as the sum of its words, and remembered;
        beyond `kept` tokens it starts anew. The last column counts a token's words.
        """
        index: dict[str, int] = {}
        rows = np.zeros((1024, self.matrix.shape[1] + 1))

        def score(text: str | None) -> tuple[str, float]:
            nonlocal rows
            count = Counter((text or "").lower().split())
            if not count or not self.langs:
                return "und", 0.0
            if len(index) > kept:
                index.clear()
            new = [t for t in count if t not in index]
            if new:
                at = len(index)
                while at + len(new) > len(rows):
                    rows = np.concatenate([rows, np.zeros_like(rows)])
                parts = [LETTERS.findall(t) for t in new]
                size = np.fromiter(map(len, parts), int, len(parts))
                block = np.zeros((len(new), rows.shape[1]))
                block[:, -1] = size
                if size.any():
                    words = self.words([w for p in parts for w in p])
                    first = np.concatenate([[0], np.cumsum(size[size > 0])[:-1]])
                    block[size > 0, :-1] = np.add.reduceat(words, first)
                rows[at : at + len(new)] = block
                index.update(zip(new, range(at, at + len(new))))
            total = np.fromiter(count.values(), float, len(count)) @ rows[[index[t] for t in count]]
            if not total[-1]:
                return "und", 0.0
            total = total[:-1]
            best = int(np.argmax(total))
            return self.langs[best], float(1 / np.exp(total - total[best]).sum())

        return score


def train(docs: DataFrame, max_docs: int = 3000, max_terms: int = 8000) -> Model:
    """Counts words and n-grams of labelled documents that are not held out.

    Bounds: about max_docs labelled documents, drawn evenly by a hash of the id, but FLOOR of each
    language or all that it has; and the words and n-grams that are among the max_terms commonest of
    their order in some language, with their counts in all, so the model never grows with the
    corpus. No labelled rows: a model without languages.
    """
    rows = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    size = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    n = sum(size.values())
    if n > max_docs:
        rate = F.create_map(*[F.lit(x) for lang, k in size.items() for x in (lang, float(max(max_docs / n, FLOOR / k)))])
        rows = rows.where(uniform(F.col("doc_id"), seed=3) < rate[F.col("lang")])

    def count(batches):
        seen: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                seen.setdefault(lang, Counter()).update(LETTERS.findall((text or "").lower()))
        for lang, words in seen.items():
            for order in range(LONGEST + 1):
                c = words if not order else Counter()
                if order:
                    for w, k in words.items():
                        for g in grams(w, order):
                            c[g] += k
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(c), "ord": pa.array([order] * len(c), pa.int32()), "gram": list(c), "n": pa.array(c.values(), pa.int64())}, schema=out)

    out = pa.schema([("lang", pa.string()), ("ord", pa.int32()), ("gram", pa.string()), ("n", pa.int64())])
    counts = rows.select("lang", "text").mapInArrow(count, "lang string, ord int, gram string, n bigint").groupBy("lang", "ord", "gram").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang", "ord").orderBy(F.desc("n"), "gram")
    ranked = counts.withColumn("r", F.row_number().over(top))
    kept = ranked.withColumn("best", F.min("r").over(Window.partitionBy("ord", "gram"))).where(F.col("best") <= max_terms).drop("r", "best")
    return Model([tuple(r) for r in kept.collect()])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (posterior, 0 to 1) of every whole text.

    Null, empty or letterless text: `und` and 0; numbers that look like letters, such as ² or Ⅳ, are
    none. The model is broadcast; its size is bounded by train(). Ties go to the first language by
    name. Every row is scored, repeated ones too; an empty table gives no row, and columns other
    than doc_id and text don't matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = shared.value.scorer()
        for b in batches:
            got = [score(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def language_id(docs: DataFrame, max_docs: int = 3000, max_terms: int = 8000) -> DataFrame:
    """doc_id, held_out, lang_pred, score; see train() and identify()."""
    return identify(docs, train(docs, max_docs, max_terms)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
