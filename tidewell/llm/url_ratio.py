"""URL filtering by the ratio of two character language models (operator 5).

Rules come first: a rule names a host and the beginning of a path, fits that host and all its subdomains, and the
longest that fits decides. URLs that no rule fits are judged by their characters: two Markov models of variable order,
one of accepted and one of rejected URLs, each blending the orders from 0 to ORDER by how often and how variously
a context went on (Witten-Bell smoothing). The difference of the two log-likelihoods, divided by the URL's
length, is compared with a threshold set on URLs kept out of training, where both errors are equally rare.

Training covers all distinct URLs, of which those whose host holds one of REJECTED_TERMS are rejected ones. Executors
count what the models need, and the threshold is set on a quarter of all URLs, chosen by hash. Up to MOST_GRAMS counts of
either kind are sent to executors whole. If there are more, none is left out: the counts stay a table, and what they say
of the grams to be scored is found by joins; the values of the MOST_GRAMS most frequent of those are sent, and the rest
are joined to their URLs. Scores are the same either way. A few made-up URLs of either kind are always part, so that both
models exist.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.shared import pick, remove, stored, work_dir

ORDER, MOST_GRAMS = 5, 200_000
#: Counts of one task before they are passed on; steps of the score for each unit, in which held-out URLs are counted; URLs
#: whose joined values are in Python at once.
FLUSH, STEPS, AT_ONCE = 200_000, 10_000, 500
#: What marks a host as rejected in training.
REJECTED_TERMS = ("casino", "pills", "viagra", "bets", "betting", "spam", "ads-", "track", "porn", "xxx", "loan", "replica", "warez", "poker", "escort", "clickbait")
SEEDS = (
    [f"{t}.example.{s}/{p}" for t in ("news", "docs", "library", "www.museum", "blog.garden", "m.weather") for s in ("com", "org", "net") for p in ("en/12", "about.html", "")],
    [f"{t}.example.{s}/{p}" for t in ("cheap-pills", "casino-win", "free-bets", "www.spam-farm", "ads-track", "m.poker-loan") for s in ("com", "org", "net") for p in ("en/12", "go?x=1", "")],
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host: after the first :// up to /, ?, # or the end, A-Z lower-cased; the path: then up to ?, # or the end."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, k), F.lit("")) for k in (1, 2))
    return F.translate(host, upper, lower), path


def by_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The rule that decides, as host and path, and its verdict; null where none fits. rules: (verdict, host, path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def grams(text: str) -> Iterator[str]:
    """Each character after its contexts of 0 to ORDER characters, with marks at either end."""
    padded = "\x02" * ORDER + text + "\x03"
    for i in range(ORDER, len(padded)):
        for k in range(ORDER + 1):
            yield padded[i - k : i + 1]


def longest(text: str) -> list[str]:
    """Each character after all its ORDER characters of context."""
    padded = "\x02" * ORDER + text + "\x03"
    return [padded[i - ORDER : i + 1] for i in range(ORDER, len(padded))]


class Markov:
    """How often characters follow contexts of up to ORDER characters: from texts, and from grams counted elsewhere."""

    def __init__(self, texts: list[str], counted: Iterable[tuple[str, int]] = ()):
        self.after: dict[str, dict[str, int]] = {}
        for text in texts:
            for gram in grams(text):
                self.add(gram, 1)
        for gram, n in counted:
            self.add(gram, n)
        self.total = {c: sum(n.values()) for c, n in self.after.items()}

    def add(self, gram: str, n: int) -> None:
        seen = self.after.setdefault(gram[:-1], {})
        seen[gram[-1]] = seen.get(gram[-1], 0) + n

    def probability(self, context: str, c: str) -> float:
        p = 1 / 256
        for k in range(len(context) + 1):
            seen = self.after.get(context[len(context) - k :])
            if seen is None:
                break
            kinds, total = len(seen), self.total[context[len(context) - k :]]
            p = (seen.get(c, 0) + kinds * p) / (total + kinds)
        return p


class Ratio:
    """Two models and the threshold between them."""

    #: Where both models are too large to be held here: all their counts.
    table: Table | None = None

    def __init__(self, accepted: list[str], rejected: list[str]):
        kept = [[u for i, u in enumerate(us) if i % 4] + seeds for us, seeds in zip((accepted, rejected), SEEDS)]
        self.accepted, self.rejected = (Markov(us) for us in kept)
        self.known: dict[str, float] = {}
        self.calibrate(*(Counter(map(self.score, us[::4])) for us in (accepted, rejected)))

    @classmethod
    def of(cls, accepted: Markov, rejected: Markov) -> Ratio:
        """From models; the threshold is set by calibrate()."""
        out = cls.__new__(cls)
        out.accepted, out.rejected, out.known, out.threshold = accepted, rejected, {}, 0.0
        return out

    def calibrate(self, good: dict[float, int], bad: dict[float, int]) -> None:
        """Set the threshold from how often each score is that of a held-out accepted, or rejected, URL."""
        good, bad = (n or Counter(map(self.score, seeds)) for n, seeds in zip((good, bad), SEEDS))
        n_good, n_bad = sum(good.values()), sum(bad.values())
        lost, caught, errors = 0, 0, []
        for m in sorted({*good, *bad}):
            errors.append((abs(lost / n_good - (n_bad - caught) / n_bad), lost / n_good + (n_bad - caught) / n_bad, m))
            lost, caught = lost + good.get(m, 0), caught + bad.get(m, 0)
        least = min(e[1] for e in errors)
        # between the classes if they part, else where the errors are alike
        parted = [m for _, total, m in errors if total <= least + 1e-9]
        below = max((x for x in bad if x < parted[-1]), default=parted[-1])
        self.threshold = (parted[-1] + below) / 2 if least == 0 else min(errors)[2]

    def score(self, url: str) -> float:
        """Log-likelihood as accepted less that as rejected, for each character."""
        if self.table is not None:
            raise ValueError("the counts of these models are a table; score URLs by judge()")
        known, total = self.known, 0.0
        for gram in longest(url):
            value = known.get(gram)
            if value is None:
                if len(known) > 500_000:  # bounded memory: start again
                    known.clear()
                value = known[gram] = math.log(self.accepted.probability(gram[:-1], gram[-1])) - math.log(self.rejected.probability(gram[:-1], gram[-1]))
            total += value
        return total / (len(url) + 1)


def _counted(urls: DataFrame) -> DataFrame:
    """gram, good and bad: how often each is in accepted and in rejected URLs."""

    def rows(held: tuple[Counter, Counter]) -> pa.RecordBatch:
        names = list(held[0] | held[1])
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([n[g] for g in names], pa.int64()) for n in held]], ["gram", "good", "bad"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Counter(), Counter())
        for batch in batches:
            for u, bad in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[bad].update(grams(u))
                if len(held[0]) + len(held[1]) > FLUSH:
                    yield rows(held)
                    held = (Counter(), Counter())
        yield rows(held)

    return urls.select("u", "bad").mapInArrow(run, "gram string, good long, bad long").groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


class Table:
    """Both models as tables, of any number of counts."""

    def __init__(self, counts: DataFrame, most: int):
        """From the counts of all grams of URLs, without those of the made-up ones; at most `most` values are sent out."""
        self.most, self.work = most, work_dir(counts.sparkSession, "url-table")
        of = [Counter(g for u in seeds for g in grams(u)) for seeds in SEEDS]
        made_up = counts.sparkSession.createDataFrame([(g, of[0][g], of[1][g]) for g in of[0] | of[1]], counts.schema)
        both = counts.union(made_up).groupBy("gram").agg(*[F.sum(kind).alias(kind) for kind in ("good", "bad")])
        self.counts = stored(both.withColumn("size", F.length("gram")), f"{self.work}/counts")
        sums = [x for kind in ("good", "bad") for x in (F.sum(kind).alias(f"{kind}_total"), F.count_if(F.col(kind) > 0).alias(f"{kind}_kinds"))]
        self.contexts = stored(self.counts.groupBy(F.expr("left(gram, size - 1)").alias("context")).agg(*sums).withColumn("size", F.length("context")), f"{self.work}/contexts")

    def _values(self, asked: DataFrame, work: str) -> DataFrame:
        """asked (gram of full length, n) with each gram's value: the difference of the logarithms of its two probabilities.

        Probabilities go from no context to the full one. A round's joins are on a gram, its context and the gram without its first
        character; at most as many rows as there are characters share one of these.
        """
        before = None
        for k in range(ORDER + 1):
            rows = asked.select(F.expr(f"right(gram, {k + 1})").alias("gram")).distinct()
            rows = rows.join(self.counts.where(F.col("size") == k + 1).drop("size"), "gram", "left")
            rows = rows.withColumn("context", F.expr(f"left(gram, {k})")).join(self.contexts.where(F.col("size") == k).drop("size"), "context", "left")
            if before is not None:
                rows = rows.withColumn("shorter", F.expr(f"right(gram, {k})")).join(before, "shorter")
            found = []
            for kind in ("good", "bad"):
                n, total, kinds = F.coalesce(F.col(kind), F.lit(0)), F.col(f"{kind}_total"), F.col(f"{kind}_kinds")
                p = F.lit(1 / 256) if before is None else F.col(f"{kind}_before")
                found.append(F.when(total > 0, (n + kinds * p) / (total + kinds)).otherwise(p).alias(f"{kind}_before"))
            before = stored(rows.select(F.col("gram").alias("shorter"), *found), f"{work}/order{k}")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = [math.log(x) - math.log(y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64())], ["gram", "n", "value"])

        rows = asked.join(before.withColumnRenamed("shorter", "gram"), "gram").select("gram", "n", "good_before", "bad_before")
        return rows.mapInArrow(run, "gram string, n long, value double")

    def scores(self, urls: DataFrame) -> DataFrame:
        """u and score, as Ratio.score has it, for each of the distinct URLs u."""
        work = work_dir(urls.sparkSession, "url-scores")
        urls = stored(urls.select("u").withColumn("k", F.monotonically_increasing_id()), f"{work}/urls")

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = Counter()
            for batch in batches:
                for u in batch.column(0).to_pylist():
                    held.update(longest(u))
                    if len(held) > FLUSH:
                        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["gram", "n"])
                        held = Counter()
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["gram", "n"])

        asked = stored(urls.select("u").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")), f"{work}/asked")
        values = stored(self._values(asked, work), f"{work}/values")
        often = values.orderBy(F.desc("n"), "gram").limit(self.most).select("gram", "value").toArrow()
        sent = urls.sparkSession.sparkContext.broadcast(dict(zip(often.column(0).to_pylist(), often.column(1).to_pylist())))

        def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, AT_ONCE):
                    part = batch.slice(start, AT_ONCE)
                    pairs = [(k, g) for u, k in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for g in set(longest(u)) if g not in sent.value]
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in pairs], pa.int64()), pa.array([g for _, g in pairs], pa.string())], ["k", "gram"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = sent.value
            for batch in batches:
                for start in range(0, batch.num_rows, AT_ONCE):
                    part = batch.slice(start, AT_ONCE)
                    found = []
                    for u, pairs in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                        more, total = {x["gram"]: x["value"] for x in pairs or ()}, 0.0
                        for gram in longest(u):
                            total += known[gram] if gram in known else more[gram]
                        found.append(total / (len(u) + 1))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.float64())], ["u", "score"])

        rows = urls.withColumn("more", F.lit(None).cast("array<struct<gram: string, value: double>>"))
        if values.count() > self.most:
            more = urls.mapInArrow(rare, "k long, gram string").join(values.select("gram", "value"), "gram")
            rows = urls.join(more.groupBy("k").agg(F.collect_list(F.struct("gram", "value")).alias("more")), "k", "left")
        out = stored(rows.select("u", "more").mapInArrow(run, "u string, score double"), f"{work}/scores")
        sent.unpersist()
        for name in ("urls", "asked", "values", *[f"order{k}" for k in range(ORDER + 1)]):
            remove(urls.sparkSession, f"{work}/{name}")
        return out


def train(df: DataFrame, url_column: str = "url", most: int = MOST_GRAMS) -> Ratio:
    """Models from all distinct URLs: three quarters by hash are counted, and the threshold is set on the rest."""
    url = pick(df, url_column)[0].cast("string")
    host = host_and_path(url)[0]
    rest = F.regexp_replace(url, r"(?s)^.*?://", "")
    term = F.lit(False)
    for t in REJECTED_TERMS:
        term = term | F.contains(host, F.lit(t))
    spark, work = df.sparkSession, work_dir(df.sparkSession, "url-models")
    rows = df.select(rest.alias("u"), term.alias("bad")).where("u is not null and u <> ''").distinct()
    rows = stored(rows.withColumn("held", F.pmod(F.xxhash64("u"), F.lit(4)) == 0), f"{work}/urls")
    counts = stored(_counted(rows.where("not held")), f"{work}/grams")
    if max(counts.agg(*[F.count_if(F.col(kind) > 0) for kind in ("good", "bad")]).first()) > most:
        return _train_by_table(rows.where("held"), Table(counts, most))
    held = [counts.where(F.col(kind) > 0).select("gram", kind).toArrow() for kind in ("good", "bad")]
    model = Ratio.of(*(Markov(seeds, zip(of.column(0).to_pylist(), of.column(1).to_pylist())) for of, seeds in zip(held, SEEDS)))
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = [math.floor(sent.value.score(u) * STEPS) for u in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(steps, pa.int64()), batch.column(1)], ["step", "bad"])

    found = rows.where("held").select("u", "bad").mapInArrow(run, "step long, bad boolean").groupBy("step", "bad").count().collect()
    model.calibrate(*({(r["step"] + 0.5) / STEPS: r["count"] for r in found if r["bad"] == bad} for bad in (False, True)))
    sent.unpersist()
    return model


def _train_by_table(held: DataFrame, table: Table) -> Ratio:
    """The rest of train() where there are too many counts to send out; here the models hold the made-up URLs alone."""
    model = Ratio.of(*(Markov(seeds) for seeds in SEEDS))
    model.table = table
    step = F.floor(F.col("score") * STEPS).alias("step")
    found = table.scores(held).join(held.select("u", "bad"), "u").groupBy(step, "bad").count().collect()
    counted = [{(r["step"] + 0.5) / STEPS: r["count"] for r in found if r["bad"] == bad} for bad in (False, True)]
    for n, seeds in zip(counted, SEEDS):
        if not n:
            n.update(Counter(r["score"] for r in table.scores(held.sparkSession.createDataFrame([(u,) for u in seeds], "u string")).collect()))
    model.calibrate(*counted)
    return model


def _judge_by_table(rows: DataFrame, model: Ratio) -> DataFrame:
    """The rest of judge() for models whose counts are a table. rows: id, url, host, path, rule, by_rule."""
    bare = F.nullif(F.regexp_replace("url", r"(?s)^.*?://", ""), F.lit(""))
    open_rows = rows.where("by_rule is null").withColumn("u", F.coalesce(bare, F.col("url"), F.lit("")))
    scored = open_rows.join(model.table.scores(open_rows.select("u").distinct()), "u", "left")
    verdict = F.when(F.col("score") >= model.threshold, "allow").otherwise("block")
    decided = rows.where("by_rule is not null").select("id", "host", "path", "rule", F.col("by_rule").alias("verdict"), F.lit(None).cast("double").alias("score"))
    return decided.union(scored.select("id", "host", "path", "rule", verdict.alias("verdict"), "score"))


def judge(df: DataFrame, rules: list[tuple[str, str, str]], model: Ratio, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """For each row: id, host, path, rule, verdict (the rule's, else the models') and score (null where a rule decided).

    A null url has an empty host and path and the score of the empty text. Repeated rows are repeated, a null id stays null.
    """
    own, url = pick(df, id_column, url_column)
    host, path = host_and_path(F.col("url"))
    rows = df.select(own.alias("id"), url.cast("string").alias("url")).select("id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("by_rule"))
    if model.table is not None:
        return _judge_by_table(rows, model).withColumnRenamed("id", id_column)
    held = df.sparkSession.sparkContext.broadcast((model, model.threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, threshold = held.value
        for batch in batches:
            scores = [None if v is not None else ratio.score((u or "").partition("://")[2] or u or "") for u, v in zip(batch.column(1).to_pylist(), batch.column(5).to_pylist())]
            verdict = [v if v is not None else ("allow" if s >= threshold else "block") for v, s in zip(batch.column(5).to_pylist(), scores)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), batch.column(4), pa.array(verdict, pa.string()), pa.array(scores, pa.float64())], ["id", "host", "path", "rule", "verdict", "score"])

    judged = rows.mapInArrow(run, f"id {dict(df.dtypes)[id_column]}, host string, path string, rule string, verdict string, score double")
    return judged.withColumnRenamed("id", id_column)
