"""The best row of a table for each of a table of questions.

Questions: id, norm (normal form), tokens (see ``functions.questions.tokens``). Answers are compared
row by row for a block of questions; passages are found by the postings of an index.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspark.operators import word_index as wi
from lexspark.operators.assistant import asked_of
from lexspark.sources import shared

LEAST_ANSWER, LEAST_PASSAGE = 6, 5


def _one_if(c: Column) -> Column:
    return F.coalesce(c.cast("int"), F.lit(0))


def _best(scored: DataFrame) -> DataFrame:
    """id, row_ord, score: the row with most, the first of equal ones."""
    return scored.groupBy("id").agg(
        F.max_by("row_ord", F.struct("score", -F.col("row_ord"))).alias("row_ord"), F.max("score").alias("score")
    )


def best_answers(rows: DataFrame, questions: DataFrame, least: float = LEAST_ANSWER) -> DataFrame:
    """id, row_ord, score. rows: row_ord, question, answer, keywords, in normal form.

    100 for an equal question, or 12 for one that holds the other; 6 for each keyword in the
    question; 3 and 1 for each token in the row's question and answer. Nulls hold nothing; a
    question without a row of the least score has none.
    """
    own, answer = F.col("question"), F.col("answer")

    def value(r: Column) -> Column:
        q = r["norm"]
        score = F.when(own == q, 100).when(own.contains(q) | q.contains(own), 12).otherwise(0)
        score = score + 6 * F.coalesce(F.size(F.filter("keywords", lambda k: (k != "") & q.contains(k))), F.lit(0))
        score = F.aggregate(r["tokens"], score, lambda a, w: a + 3 * _one_if(own.contains(w)) + _one_if(answer.contains(w)))
        return F.when(score >= least, F.struct(score.cast("double").alias("score")))

    return _best(asked_of(rows, questions.select("id", "norm", "tokens"), value, ["row_ord"]))


#: What a token adds in the heading, what the first time in the body adds beside HALF for each time, how many times count.
IN_HEADING, IN_BODY, HALF, TIMES = 5.0, 2.0, 0.5, 5
MOST = IN_HEADING + IN_BODY + HALF * TIMES
#: What all tokens in a row add.
HEADING_PHRASE, BODY_PHRASE = 12, 8


def _points(heading: Column, times: Column) -> Column:
    return F.when(heading, IN_HEADING).otherwise(0.0) + F.when(times > 0, IN_BODY + HALF * F.least(times, F.lit(TIMES))).otherwise(0.0)


def passage_score(heading: Column, body: Column, tokens: Column) -> Column:
    """Struct of score and found (how many tokens) of a passage by its texts."""
    seen = F.transform(tokens, lambda w: F.struct(heading.contains(w).alias("h"), wi.occurrences(body, w).alias("n")))
    total = F.aggregate(seen, F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("found")), lambda a, x: F.struct(
        (a["score"] + _points(x["h"], x["n"])).alias("score"), (a["found"] + (x["h"] | (x["n"] > 0)).cast("int")).alias("found")
    ))
    phrase = F.array_join(tokens, " ")
    bonus = F.when(F.size(tokens) < 2, 0).when(heading.contains(phrase), HEADING_PHRASE).when(body.contains(phrase), BODY_PHRASE).otherwise(0)
    return F.transform(F.array(total), lambda t: F.struct((t["score"] + bonus).alias("score"), t["found"].alias("found")))[0]


class Passages:
    """Questions over an index with the fields ``heading`` and ``norm`` (the body): the best row for each question, from the blocks that can have it.

    Half of a question's tokens must be in a row, so some of its rarer ones must be, and only those
    are looked up: a token is where one of the words is that have it. What a block can give at most
    follows from the most that any of its rows has of each word, and from the commoner tokens at
    their highest. The block where that is most is scored first; what it gives is a bar. Of the
    other blocks those that can reach the bar are opened, and of their rows those that can.
    """

    def __init__(self, index: wi.WordIndex, questions: DataFrame, least: float = LEAST_PASSAGE) -> None:
        self.index, self.least = index, least
        self.questions = shared.saved(questions.where(F.size("tokens") > 0).select("id", "tokens"), "asked")
        each = self.questions.select("id", F.size("tokens").alias("n"), F.posexplode("tokens").alias("at", "token"))
        words = shared.saved(wi.words_with(index, each.select("token").distinct()), "asked-words")
        met = words.join(index.words, ["field", "word"]).groupBy("token").agg(F.sum("n_blocks").alias("df"))
        line = W.partitionBy("id").orderBy(F.coalesce("df", F.lit(0)), "at")  # the tokens of one question
        need = F.ceil(F.col("n") / 2)
        # so many tokens aren't looked up that of the others a quarter of all, and one, must be in a row
        common = F.greatest(F.lit(0), need - 1 - F.floor(F.col("n") / 4))
        self.asked = shared.saved(each.join(met, "token", "left").withColumn("rank", F.row_number().over(line)).where(
            F.col("rank") <= F.col("n") - common
        ).select("id", "at", "token", (need - common).alias("need"), (
            common * MOST + F.when(F.col("n") > 1, HEADING_PHRASE).otherwise(0)
        ).alias("rest")), "asked-tokens")
        self.words = shared.saved(words.join(self.asked.select("token").distinct(), "token", "left_semi"), "rare-words")

    def blocks(self) -> DataFrame:
        """id, block, most: the highest score that a question can have in a block, for the blocks where that is enough."""
        met = self.index.postings.select("field", "word", "block", "most").join(self.words, ["field", "word"])
        return self._possible(met, ["block"], F.col("most"), F.lit(self.least)).select("id", "block", "most")

    def _possible(self, met: DataFrame, where: list[str], times: Column, bar: Column) -> DataFrame:
        """Of places that have words: those with enough of a question's tokens, and the most that it can have there."""
        of_token = met.groupBy("token", *where).agg(
            F.max(F.col("field") == "heading").alias("heading"),
            F.coalesce(F.sum(F.when(F.col("field") == "norm", times * F.col("occurs"))), F.lit(0)).alias("times")
        )
        each = self.asked.join(of_token, "token").groupBy("id", *where).agg(
            F.count(F.lit(1)).alias("found"), F.any_value("need").alias("need"),
            (F.sum(_points(F.col("heading"), F.col("times"))) + F.any_value("rest")).alias("most")
        )
        return each.where((F.col("found") >= F.col("need")) & (F.col("most") >= bar))

    def rows(self, blocks: DataFrame) -> DataFrame:
        """id, row, most: the rows of these blocks that can reach the bar. blocks: id, block, bar (a score that the question has already)."""
        opened = self.index.postings.join(blocks.select("block").distinct(), "block", "left_semi").join(self.words, ["field", "word"])
        rows = opened.select("token", "field", "occurs", "block", F.explode("rows").alias("r")).select("*", "r.row", "r.n")
        near = self._possible(rows, ["block", "row"], F.col("n"), F.lit(self.least))
        return near.join(blocks, ["id", "block"]).where("most >= bar").select("id", "row", "most")

    def scores(self, rows: DataFrame) -> DataFrame:
        """id, row_ord, score of rows by their texts, where they have half of the tokens and the least score."""
        texts = self.index.rows.select("row", "row_ord", "heading", "norm")
        score = passage_score(F.col("heading"), F.col("norm"), F.col("tokens"))
        wide = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # scoring takes long for the bytes it reads, so it stays in as many tasks as there are partitions
        met = rows.join(self.questions, "id").select("id", "row", "tokens").repartition(wide, "row").join(texts, "row")
        scored = met.select("id", "row_ord", F.size("tokens").alias("n"), F.explode(F.array(score)).alias("s"))
        return scored.where((F.col("s.found") >= F.ceil(F.col("n") / 2)) & (F.col("s.score") >= self.least)).select("id", "row_ord", "s.score")

    def best(self) -> DataFrame:
        """id, row_ord, score; the first row of those with equal scores."""
        blocks = shared.saved(self.blocks(), "question-blocks")
        likely = blocks.groupBy("id").agg(F.max_by("block", F.struct("most", -F.col("block"))).alias("block"))
        first = self.rows(likely.withColumn("bar", F.lit(0.0)))
        one = first.groupBy("id").agg(F.max_by("row", F.struct("most", -F.col("row"))).alias("row"))
        return _best(self.scores(self.rows(self.able(blocks, self.scores(one)))))

    @staticmethod
    def able(blocks: DataFrame, scores: DataFrame) -> DataFrame:
        """id, block, bar: the blocks where a question can have what it has already, or more."""
        bars = shared.saved(scores.groupBy("id").agg(F.max("score").alias("bar")), "bars")
        return blocks.join(bars, "id", "left").fillna(0.0, "bar").where("most >= bar").select("id", "block", "bar")


def best_passages(index: wi.WordIndex, questions: DataFrame, least: float = LEAST_PASSAGE) -> DataFrame:
    """id, row_ord, score of the best row of an index for each question.

    For each token 5 if the heading has it, and 2 and a half for each of up to five times that the
    body has it. Half of the tokens must be found. All tokens in a row add 12 in the heading, else
    8 in the body. A question without tokens finds nothing, an empty index neither; ids tell questions apart.
    """
    return Passages(index, questions, least).best()


#: Up to so many questions go to all tasks; more are worth an index.
SCANNED = 2000
#: A task remembers the tokens of so many words.
KNOWN_WORDS = 200_000


def best_passages_by_scan(rows: DataFrame, questions: DataFrame, least: float = LEAST_PASSAGE) -> DataFrame:
    """The same for at most SCANNED questions and rows that have no index (row_ord, heading, norm): one scan, and one row of each task for each question.

    A token has no spaces, so it occurs in words only: a row's words are counted, and each different
    word is looked up once in a task for the tokens that it has. A phrase is looked for where a row
    has all of its tokens and could be the best one of the task with it.
    """
    asked = [(r.id, r.tokens) for r in questions.where(F.size("tokens") > 0).select("id", "tokens").limit(SCANNED + 1).collect()]
    if len(asked) > SCANNED:
        raise ValueError(f"more than {SCANNED} questions need an index")
    kind = rows.select("row_ord").join(questions.select("id"), F.lit(False)).select("id", "row_ord", F.lit(0.0).alias("score")).schema
    if not asked:
        return rows.sparkSession.createDataFrame([], kind)
    number = {t: i for i, t in enumerate(dict.fromkeys(t for _, ts in asked for t in ts))}
    tree = {}  # of the tokens' characters; "" holds a token's number
    for t, i in number.items():
        node = tree
        for c in t:
            node = node.setdefault(c, {})
        node[""] = i
    tokens = list(number)
    size = np.array([len(ts) for _, ts in asked])
    of_question, first = np.array([number[t] for _, ts in asked for t in ts]), np.concatenate([[0], np.cumsum(size)[:-1]])
    phrases = [" ".join(ts) for _, ts in asked]

    def tokens_in(word: str) -> tuple[np.ndarray, np.ndarray] | tuple[()]:
        """The tokens that a word has, and how often; nothing if it has none."""
        has = set()
        for i in range(len(word)):
            node, j = tree, i
            while j < len(word) and (node := node.get(word[j])) is not None:
                j += 1
                if "" in node:
                    has.add(node[""])
        return (np.array([*has]), np.array([word.count(tokens[t]) for t in has], float)) if has else ()

    def times_of(text: str, known: dict) -> np.ndarray:
        """How often a text has each token."""
        met = []
        for word, n in Counter(text.split(" ")).items():
            if (has := known.get(word)) is None:
                has = known[word] = tokens_in(word)
            if has:
                met.append((*has, n))
        if not met:
            return np.zeros(len(tokens))
        which, occurs, n = zip(*met, strict=True)
        times = np.concatenate(occurs) * np.repeat(n, [len(w) for w in which])
        return np.bincount(np.concatenate(which), times, len(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, at, known = np.full(len(asked), float(least)), [None] * len(asked), {}
        for batch in batches:
            for row_ord, heading, norm in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                heading, norm = heading or "", norm or ""
                if len(known) > KNOWN_WORDS:
                    known.clear()
                times, head = times_of(norm, known), times_of(heading, known) > 0
                points = np.where(head, IN_HEADING, 0.0) + np.where(times > 0, IN_BODY + HALF * np.minimum(times, TIMES), 0.0)
                score = np.add.reduceat(points[of_question], first)
                found = np.add.reduceat(((times > 0) | head)[of_question].astype(int), first)
                whole = (found == size) & (size > 1)
                for q in np.nonzero((2 * found >= size) & (score + HEADING_PHRASE * whole >= best))[0].tolist():
                    s = float(score[q])
                    if whole[q]:
                        s += HEADING_PHRASE if phrases[q] in heading else BODY_PHRASE if phrases[q] in norm else 0
                    rank = (row_ord is not None, -(row_ord or 0))
                    if s > best[q] or s == best[q] and (at[q] is None or rank > at[q][0]):
                        best[q], at[q] = s, (rank, row_ord)
        have = [q for q, x in enumerate(at) if x is not None]
        ids, rows_at, scores = [asked[q][0] for q in have], [at[q][1] for q in have], [float(best[q]) for q in have]
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids, types[0]), "row_ord": pa.array(rows_at, types[1]), "score": pa.array(scores, pa.float64())})

    types = [pa.int32() if kind[c].dataType.simpleString() == "int" else pa.int64() for c in ("id", "row_ord")]
    return _best(rows.select("row_ord", "heading", "norm").mapInArrow(run, kind))


def best_passages_by_rows(rows: DataFrame, questions: DataFrame, least: float = LEAST_PASSAGE) -> DataFrame:
    """The same for a few questions and rows that have no index (row_ord, heading, body in normal form): every question meets every row."""
    heading, body = F.coalesce("heading", F.lit("")), F.coalesce("body", F.lit(""))

    def value(r: Column) -> Column:
        s, words = passage_score(heading, body, r["tokens"]), F.size(r["tokens"])
        return F.when((words > 0) & (s["found"] >= F.ceil(words / 2)) & (s["score"] >= least), F.struct(s["score"].alias("score")))

    return _best(asked_of(rows, questions.select("id", "norm", "tokens"), value, ["row_ord"]))
