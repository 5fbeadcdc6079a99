"""Language identification by Bayesian fusion of evidence (operator 8).

For each language l, the posterior of a text is the product of

    P(text | l)       a mixture-free n-gram model over hashed byte trigrams, tempered as neighbouring trigrams depend on each other
    P(declared | l)   how often markup declares what it does in texts of l, counted over all rows
    P(l | host)       a prior that shrinks from host to domain to address suffix to all rows: each level adds its counts
                      to KAPPA times the level above; a row's own part is taken out first

The counts are sums of text posteriors, one grouped aggregation for each level, so a host with a third of all rows
costs one row per task and language. Texts are read once; what they give is stored, and the rest are joins on keys.
Every language in the labels has a model. It is fitted on a bounded sample, SAMPLE texts of 20 to SAMPLE_BYTES bytes;
a language without such texts is fitted on up to SAMPLE shorter and LONG longer ones, whole. Posteriors are stored
sparsely: languages that are MOST_EVIDENCE behind the best one are left out and put back when evidence is fused.

One more class stands for text of no language that has a model: any trigram is as likely there as another. A text that
fits no model, be it symbols or another language, is of that class whatever it declares.

Defined results: a text without trigrams is judged by the other evidence; missing evidence of any kind says nothing;
a text with no evidence at all has the language `und` and confidence 0, as has one whose best language is no better
than LEAST or is the class of no language. Ids may repeat or be null; every row gets a result. Texts are read whole, however
long; columns of other names than those given are ignored. Hosts count without user and port, and addresses in numbers
have no suffix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.shared import pick, stored, text_slices

SAMPLE, SAMPLE_BYTES, LONG = 300, 20_000, 20
BITS, SMOOTH, TEMPER, MOST_EVIDENCE = 16, 0.3, 0.25, 60.0
KAPPA, LEAST = 5.0, 0.5
#: Fixed value: what text that fits no model, or has no evidence, is called.
NONE = "und"


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of lower-cased texts, and where each text's begin (one place more). Runs of anything but
    letters are one space, which also stands at both ends; a text without letters has none."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    n = len(texts)
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if n and texts.buffers()[2] else np.zeros(0, np.uint8)
    ends = np.cumsum(sizes)
    data = np.insert(raw, np.concatenate([[0], ends]) if n else np.zeros(0, np.int64), np.uint8(32))
    owner_ends = ends + np.arange(2, n + 2)  # one space before each text and one after the last
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    kept = letter | np.concatenate([[True], letter[:-1]])
    values = np.where(letter, data, np.uint8(32))[kept].astype(np.uint32)
    place = np.cumsum(kept)
    if len(values) < 3:
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    code = (values[:-2] << 16) | (values[1:-1] << 8) | values[2:]
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    # a trigram belongs to the text in which it begins, if its middle is a letter
    middle = (values[1:-1] != 32)
    at = np.searchsorted(np.flatnonzero(middle), np.concatenate([[0], place[owner_ends - 2] - 1 if n else []]), "left")
    return code[middle].astype(np.int64), np.minimum(at, int(middle.sum()))


class Model:
    """Log-probabilities of hashed trigrams for each language, and for text of none, of which any is as likely as another."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        """From the trigrams of each language and how often each is."""
        self.languages = names = sorted(set(counts) - {NONE})
        self.classes = [*names, NONE] if names else []
        self.table = np.zeros((1 << BITS, len(self.classes)), np.float32)
        mean = np.zeros(1 << BITS)
        for j, l in enumerate(names):
            count = np.full(1 << BITS, SMOOTH)
            count[counts[l][0]] += counts[l][1]
            logs = np.log(count / count.sum())
            mean += logs / len(names)
            self.table[:, j] = logs
        self.table[:, len(names) :] = -np.log(1 << BITS)
        self.table -= mean[:, None].astype(np.float32)

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """Tempered log-likelihoods up to a constant for each text, at most MOST_EVIDENCE apart from the best."""
        code, at = grams(texts)
        n = len(at) - 1
        out = np.zeros((n, len(self.classes)))
        some = np.flatnonzero(np.diff(at))
        if len(some):
            for j in range(len(self.classes)):
                out[some, j] = np.add.reduceat(self.table[code, j].astype(np.float64), at[:-1][some])
        out *= TEMPER
        return np.maximum(out - out.max(1, keepdims=True, initial=-np.inf), -MOST_EVIDENCE) if out.shape[1] else out


def _counted_in_parts(texts: DataFrame) -> DataFrame:
    """lang, code and n: how often each trigram is in a slice of the texts of each language.

    The texts of a language, a bounded sample, come together first. Else each task would list the trigrams of its few texts,
    and the more tasks there are, the more often the same trigram would be listed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, most_bytes=2 << 20):
                code, at = grams(part.column(1))
                own = part.column(0).dictionary_encode()
                owner = np.repeat(own.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(at))
                pairs, n = np.unique((owner << BITS) | code, return_counts=True)
                # a language is there even if its texts have no trigrams
                names = pa.concat_arrays([own.dictionary.take(pa.array(pairs >> BITS)), own.dictionary])
                more = np.zeros(len(own.dictionary), np.int64)
                yield pa.RecordBatch.from_arrays([names, pa.array(np.concatenate([pairs & ((1 << BITS) - 1), more])), pa.array(np.concatenate([n, more]))], ["lang", "code", "n"])

    return texts.select("lang", "text").repartition("lang").mapInArrow(run, "lang string, code long, n long")


def _counted(texts: DataFrame) -> DataFrame:
    """lang, code and n: how often each trigram is in the texts of each language."""
    return _counted_in_parts(texts).groupBy("lang", "code").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, text_column: str = "text", language_column: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of labelled texts: of each language, sample texts by hash."""
    rows = labelled.select(*[c.alias(x) for c, x in zip(pick(labelled, text_column, language_column), ("text", "lang"))]).where("lang is not null and text is not null")
    size = F.octet_length("text")
    kind = F.when(size.between(20, SAMPLE_BYTES), 0).when(size < 20, 1).otherwise(2)
    hashed = rows.withColumn("h", F.xxhash64("text")).withColumn("kind", kind)
    # the hash up to which each language's texts of a kind are taken, found without moving texts
    ranked = hashed.select("lang", "kind", "h").withColumn("r", F.row_number().over(Window.partitionBy("lang", "kind").orderBy("h"))).where((F.col("r") <= sample) & ((F.col("kind") < 2) | (F.col("r") <= LONG)))
    last = ranked.groupBy("lang", "kind").agg(F.max("h").alias("last")).collect()
    usual = {r["lang"] for r in last if r["kind"] == 0}
    wanted = [(r["lang"], r["kind"], r["last"]) for r in last if r["kind"] == 0 or r["lang"] not in usual]
    if not wanted:
        return Model({})
    bounds = labelled.sparkSession.createDataFrame(wanted, "lang string, kind int, last long")
    chosen = hashed.join(F.broadcast(bounds), ["lang", "kind"]).where("h <= last").select("lang", "text").distinct()
    found = _counted(chosen).toArrow()
    names, codes, counts = found.column("lang").combine_chunks().dictionary_encode(), found.column("code").to_numpy(), found.column("n").to_numpy()
    owner = names.indices.to_numpy()
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(len(names.dictionary) + 1))
    return Model({l: (codes[order[a:b]], counts[order[a:b]]) for l, a, b in zip(names.dictionary.to_pylist(), cuts[:-1], cuts[1:])})


def bare_host(authority: Column) -> Column:
    """A host in lower case without user, port and last dot; null if nothing is left."""
    host = F.regexp_replace(F.regexp_replace(F.lower(authority), r"(?s)^.*@", ""), r"\.?(:[0-9]*)?$", "")
    return F.nullif(host, F.lit(""))


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """The last label of a host, and its last two; null for addresses in numbers."""
    number = host.rlike(r"^([0-9.]+|\[.*\])$")
    return F.when(~number, F.element_at(F.split(host, r"\."), -1)), F.when(~number, F.regexp_extract(host, r"([^.]*\.)?[^.]*$", 0))


def _spread(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of (j, q) as rows of a matrix; what is not listed is 0."""
    out = np.zeros((len(lists), width))
    values = lists.flatten()
    owner = np.repeat(np.arange(len(lists)), pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))
    out[owner, values.field("j").to_numpy(zero_copy_only=False)] = values.field("q").to_numpy(zero_copy_only=False)
    return out


def _fused(own: np.ndarray, levels: list[np.ndarray], said: np.ndarray, declares: np.ndarray, everything: np.ndarray) -> np.ndarray:
    """Logarithms of posteriors up to a constant for each row, from the text's own part and the sums of its keys.

    levels go from address suffix to host; said are the sums of what the row declares, if it declares anything.
    """
    width = len(everything)
    # from all rows down to the host, without the row itself
    prior = (everything - own + 1.0) / (everything.sum() - own.sum(1, keepdims=True) + width)
    for level in levels:
        counts = np.maximum(level - own, 0.0)
        prior = (counts + KAPPA * prior) / (counts.sum(1, keepdims=True) + KAPPA)
    declared = np.log((np.maximum(said - own, 0.0) + 0.05) / (everything + 1.0))
    with np.errstate(divide="ignore"):
        text = np.log(own)
    best = own.max(1, keepdims=True)
    text = np.where(best > 0, np.maximum(text, np.log(np.where(best > 0, best, 1.0)) - MOST_EVIDENCE), 0.0)
    return text + np.log(prior) + np.where(declares[:, None], declared, 0.0)


def identify(df: DataFrame, model: Model, work: str, id_column: str, text: Column, declared: Column, host: Column) -> DataFrame:
    """For each row: id, lang, confidence, text_lang (by text alone) and declared.

    The result has one row for each row of df; ids need not be unique.
    """
    classes = model.classes
    width = len(classes)
    held = df.sparkSession.sparkContext.broadcast(model)
    id_type = dict(df.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, most_bytes=2 << 20):
                e = held.value.evidence(part.column(1))
                weight = np.exp(e)
                heard = (e != 0).any(1)
                kept = heard[:, None] & (e > -MOST_EVIDENCE)
                q = weight / weight.sum(1, keepdims=True) if width else weight
                pairs = pa.StructArray.from_arrays([pa.array(np.nonzero(kept)[1].astype(np.int32)), pa.array(q[kept])], ["j", "q"])
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept.sum(1))]), pa.int32()), pairs)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), listed], ["id", "declared", "host", "own"])

    rows = df.select(pick(df, id_column)[0].alias("id"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), F.lower(declared.cast("string")).alias("declared"), host.cast("string").alias("host"))
    read = rows.mapInArrow(run, f"id {id_type}, declared string, host string, own array<struct<j: int, q: double>>")
    if not classes:
        return read.select(F.col("id").alias(id_column), F.lit(NONE).alias("lang"), F.lit(0.0).alias("confidence"), F.lit(NONE).alias("text_lang"), "declared")
    suffix, domain = suffix_and_domain(F.col("host"))
    seen = stored(read.select("id", "declared", "host", F.nullif(domain, F.lit("")).alias("domain"), F.nullif(suffix, F.lit("")).alias("suffix"), "own"), f"{work}/evidence")

    # sums over all rows; the rest are sums of them, for the levels nest
    each = seen.select("host", "domain", "suffix", "declared", F.inline("own"))
    by_host = stored(each.groupBy("host", "domain", "suffix", "declared", "j").agg(F.sum("q").alias("q")), f"{work}/counts")
    everything = np.zeros(width)
    for r in by_host.groupBy("j").agg(F.sum("q").alias("q")).collect():
        everything[r["j"]] = r["q"]
    out = seen
    for key in ("host", "domain", "suffix", "declared"):
        sums = by_host.where(F.col(key).isNotNull()).groupBy(key, "j").agg(F.sum("q").alias("q"))
        out = out.join(sums.groupBy(key).agg(F.collect_list(F.struct("j", "q")).alias(f"of_{key}")), key, "left")

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = np.array([*classes, NONE], object)
        step = max(1, 500_000 // width)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                own, *levels, said = (_spread(part.column(k), width) for k in range(3, 8))
                declares, hosted = (part.column(k).is_valid().to_numpy(zero_copy_only=False) for k in (1, 2))
                heard = own.any(1)
                logs = _fused(own, levels, said, declares, everything)
                c = np.where(heard | declares | hosted, 1.0 / np.exp(logs - logs.max(1, keepdims=True)).sum(1), 0.0)
                sure = (c > LEAST) & (logs.argmax(1) < width - 1)
                lang, by_text = named[np.where(sure, logs.argmax(1), width)], named[np.where(heard, own.argmax(1), width)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(np.where(sure, c.round(6), 0.0)), pa.array(by_text, pa.string()), part.column(1)], ["id", "lang", "confidence", "text_lang", "declared"])

    fused = out.select("id", "declared", "host", "own", "of_suffix", "of_domain", "of_host", "of_declared").mapInArrow(fuse, f"id {id_type}, lang string, confidence double, text_lang string, declared string")
    return fused.withColumnRenamed("id", id_column)


def page_text(html: Column) -> Column:
    """What is left of a page without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_replace(bare, r"&[#a-zA-Z0-9]{1,10};", " ")


def declared_language(html: Column) -> Column:
    """The language of the html element, without its region; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1)), F.lit(""))


def identify_pages(pages: DataFrame, model: Model, work: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """identify() for web pages: text and declared language from the markup, host from the address."""
    url, html = pick(pages, url_column, html_column)
    host = bare_host(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return identify(pages, model, work, id_column, page_text(html), declared_language(html), host)
