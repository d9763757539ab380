"""Language identification: text likelihoods, declared language, address suffix and host priors in one posterior."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import Memo, chunks, kept, segments
from .common import column, cut, fresh, narrow, ship

#: Labelled rows of each language that the text model is fitted on, at most (in expectation).
PER_LANGUAGE = 1024
#: Words that a text's likelihood counts for, at most: words of one text aren't independent.
EFFECTIVE_WORDS = 20
#: Weight of the level above, in documents, when a host's or domain's share is smoothed.
SMOOTHING = 10.0
#: Chance that a declared language or a national suffix is the text's.
MARKUP_RELIABILITY, SUFFIX_RELIABILITY = 0.9, 0.7
UNDETERMINED = "und"
#: National suffixes and the main language of their country (fixed values).
SUFFIXES = {
    "at": "de", "br": "pt", "ch": "de", "cl": "es", "cn": "zh", "de": "de", "es": "es", "fr": "fr", "it": "it", "jp": "ja",
    "mx": "es", "nl": "nl", "pl": "pl", "pt": "pt", "ru": "ru", "uk": "en", "us": "en", "ar": "es", "au": "en", "ie": "en",
}
_WORD = re.compile(r"[^\W\d_]+")


class TrigramBayes:
    """Multinomial naive Bayes over character trigrams of words with marked ends.

    Beside the languages there is the class ``und``, under which all trigrams are equally
    likely; text that no language explains better than that is undetermined.
    """

    def __init__(self):
        self.languages: list[str] = [UNDETERMINED]
        self.row: dict[str, int] = {}
        self.logs = np.zeros((1, 1), np.float32)

    def fit(self, texts: list[str], languages: list[str], smoothing: float = 0.1) -> "TrigramBayes":
        counts: dict[str, Counter] = {k: Counter() for k in languages}
        for text, k in zip(texts, languages):
            counts[k].update(self.count(text))
        return self.fit_counts(counts, smoothing)

    @classmethod
    def count(cls, text: str) -> Counter:
        """Trigrams of a whole text."""
        words: Counter = Counter()
        for part in segments(text):
            words.update(_WORD.findall(part.lower()))
        out: Counter = Counter()
        for w, n in words.items():
            for g in cls._grams(w):
                out[g] += n
        return out

    def fit_counts(self, counts: dict[str, Counter], smoothing: float = 0.1) -> "TrigramBayes":
        names = sorted(counts)
        grams = sorted(set().union(*counts.values())) if names else []
        self.row = {g: i for i, g in enumerate(grams)}
        self.languages = [*names, UNDETERMINED]
        kinds = len(grams) + 1
        even = 1 / max(20_000, 2 * kinds)
        table = np.full((kinds, len(names) + 1), np.log(even), np.float64)
        for j, k in enumerate(names):
            own = np.array([counts[k][g] for g in grams] + [0.0])
            # with little text, less: what a language has never shown speaks for und before it
            extra = min(smoothing, own.sum() * even / 2 / (1 - kinds * even / 2))
            table[:, j] = np.log((own + extra) / (own.sum() + extra * kinds)) if extra else np.log(even / 2)
        self.logs = table.astype(np.float32)
        return self

    @staticmethod
    def _grams(word: str) -> list[str]:
        w = f"<{word}>"
        return [w[i : i + 3] for i in range(len(w) - 2)]

    def words(self, chunk: str) -> bytes:
        """Log likelihoods by class and the number of words of a chunk, as 32-bit floats."""
        unseen, rows, n = len(self.logs) - 1, [], 0
        for w in _WORD.findall(chunk.lower()):
            rows += [self.row.get(g, unseen) for g in self._grams(w)]
            n += 1
        return np.append(self.logs[rows].sum(0), np.float32(n)).astype(np.float32).tobytes()

    def likelihoods(self, text: str | None, of=None) -> tuple[np.ndarray, int]:
        """Log likelihoods of a whole text by class, scaled down to at most EFFECTIVE_WORDS words; and its words."""
        of, total = of or self.words, np.zeros(len(self.languages) + 1)
        for part in segments(text or ""):
            total += np.frombuffer(b"".join(map(of, chunks(part))), np.float32).reshape(-1, len(total)).sum(0, dtype=np.float64)
        n = int(total[-1])
        return total[:-1] * min(1.0, EFFECTIVE_WORDS / max(1, n)), n


def fit_language_model(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int = PER_LANGUAGE) -> TrigramBayes:
    """A text model fitted to a bounded sample of the rows that name their language.

    Every language that a row names is fitted, however rare: each adds a few columns to the plan
    and at most ``per_language`` rows to the sample, in expectation; which rows depends on a hash
    of id and text. Tasks count the trigrams of whole texts, and the driver gets one count for
    each trigram of a language. Rows without text or language don't count, repeated rows count
    as often as they stand there, and without labels every text is undetermined.
    """
    own = docs.select(column(id_col).cast("long").alias("id"), F.lower(F.trim(column(lang_col))).alias("lang"), column(text_col).cast("string").alias("text"))
    own = own.where("lang is not null and lang != '' and lang != 'und' and text is not null")
    counts = {r.lang: r.n for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return TrigramBayes()
    # one flat case; languages that aren't in it are taken whole
    limit = F.when(F.lit(False), 1.0)
    for k, n in counts.items():
        if n > per_language:
            limit = limit.when(F.col("lang") == k, per_language / n)
    limit = limit.otherwise(1.0)
    chosen = own.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < limit * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found.setdefault(lang, Counter()).update(TrigramBayes.count(text))
            rows = [(k, g, n) for k, own in found.items() for g, n in own.items()]
            langs, grams, n = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(grams, pa.string()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    ship(docs.sparkSession)
    grams = chosen.select("lang", "text").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    fitted: dict[str, Counter] = {k: Counter() for k in counts}
    for r in grams.toArrow().to_batches():
        for lang, gram, n in zip(*(c.to_pylist() for c in r.columns)):
            fitted[lang][gram] = n
    return TrigramBayes().fit_counts(fitted)


def identify_languages(
    docs: DataFrame,
    model: TrigramBayes,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str | None = None,
    markup_col: str | None = None,
    least: float = 0.3,
    key_text: bool = False,
) -> DataFrame:
    """One row per document: id, language, posterior, text_language, n_words, accepted.

    The posterior over the model's languages and ``und`` is the product of
    - the text's likelihood (whole texts; read once, in workers),
    - the chance of the declared language (``markup_col``, primary subtag) given each language,
    - the chance of the host's national suffix given each language,
    - the host's prior: the languages of its other documents by their text alone, summed by
      grouped aggregation and smoothed with its domain's, which is smoothed with all
      documents'. The document's own share is taken out on both levels.

    A row is accepted if its language isn't ``und`` and its posterior reaches ``least``; texts
    in two languages, whose posterior is divided, pass at the default.
    Evidence that is null or empty says nothing: a null or empty text is decided by the rest.
    Null ids and repeated rows stay; an empty table gives no rows. A host with a third of all
    rows meets its aggregate in a join that adaptive execution splits; texts don't move.
    """
    spark, names = docs.sparkSession, model.languages
    k = len(names)
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        # every chunk counts its own words, so nothing is joined from a word and a mark
        of = kept(("language", len(model.row), model.logs.tobytes()), lambda: Memo(model.words, limit=700_000)).__getitem__
        for b in batches:
            found = [model.likelihoods(t, of) for t in b.column(1).to_pylist()]
            logs = np.array([f[0] for f in found]).reshape(len(found), k)
            share = np.exp(logs - logs.max(1, keepdims=True, initial=-np.inf))
            share /= share.sum(1, keepdims=True)
            cols = [b.column(i) for i in (0, 2, 3, 4)]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array([f[1] for f in found], pa.int64()), *(pa.array(x[:, j]) for x in (logs, share) for j in range(k))],
                ["id", "host", "markup", "tag", "n_words", *(f"{x}{j}" for x in "lp" for j in range(k))],
            )

    def text_or_null(name: str | None) -> Column:
        return F.lower(F.trim(column(name).cast("string"))) if name else F.lit(None).cast("string")

    rows = docs.select(
        column(id_col).cast("long").alias("id"),
        column(text_col).cast("string").alias("text"),
        F.nullif(text_or_null(host_col), F.lit("")).alias("host"),
        F.nullif(F.regexp_extract(text_or_null(markup_col), "^[a-z]+", 0), F.lit("")).alias("markup"),
        F.xxhash64(column(text_col)).alias("tag"),
    )
    seen = cut(rows.mapInArrow(run, "id long, host string, markup string, tag long, n_words long, " + ", ".join(f"{x}{j} double" for x in "lp" for j in range(k))))
    seen = seen.select("*", F.when(F.size(F.split("host", r"\.")) > 1, F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)).alias("domain"))
    sums = [F.sum(f"p{j}") for j in range(k)]
    by_host = seen.where("host is not null").groupBy("host", "domain").agg(*(s.alias(f"h{j}") for j, s in enumerate(sums)), F.count(F.lit(1)).alias("hn"))
    by_host = cut(by_host)
    # one row, whatever the corpus
    overall = seen.agg(*(s.alias(f"g{j}") for j, s in enumerate(sums)), F.count(F.lit(1)).alias("gn")).first()
    prior = [((overall[f"g{j}"] or 0.0) + 1.0) / (overall["gn"] + k) for j in range(k)]
    by_domain = by_host.where("domain is not null").groupBy("domain").agg(*(F.sum(f"h{j}").alias(f"d{j}") for j in range(k)), F.sum("hn").alias("dn"))
    levels = by_host.join(by_domain, "domain", "left").drop("domain")
    joined = seen.join(levels, "host", "left")

    m = F.lit(SMOOTHING)
    suffix = F.create_map(*(F.lit(x) for kv in SUFFIXES.items() for x in kv))[F.regexp_extract("host", r"\.([a-z]+)$", 1)]
    scores = []
    for j, name in enumerate(names):
        dom = F.when(F.col("dn").isNull(), F.lit(prior[j])).otherwise((F.col(f"d{j}") - F.col(f"p{j}") + m * prior[j]) / (F.col("dn") - 1 + m))
        own = F.when(F.col("hn").isNull(), F.lit(prior[j])).otherwise((F.col(f"h{j}") - F.col(f"p{j}") + m * dom) / (F.col("hn") - 1 + m))
        score = F.col(f"l{j}") + F.log(F.greatest(own, F.lit(1e-9)))
        for said, sure in ((F.col("markup"), MARKUP_RELIABILITY), (suffix, SUFFIX_RELIABILITY)):
            known = F.when(said.isin(*names), said).when(said.isNotNull(), F.lit(UNDETERMINED))
            score = score + F.when(known.isNull(), 0.0).when(known == name, float(np.log(sure))).otherwise(float(np.log((1 - sure) / max(1, k - 1))))
        scores.append(score.alias(f"s{j}"))
    joined = joined.select("id", "tag", "n_words", *(f"l{j}" for j in range(k)), *scores)
    all_scores = F.array(*(F.col(f"s{j}") for j in range(k)))
    all_logs = F.array(*(F.col(f"l{j}") for j in range(k)))
    lookup = F.array(*(F.lit(x) for x in names))
    best = F.array_position(all_scores, F.col("top")).cast("int")
    out = joined.withColumn("top", F.greatest(*(f"s{j}" for j in range(k))) if k > 1 else F.col("s0")).select(
        F.col("id").alias(id_col),
        F.element_at(lookup, best).alias("language"),
        (1 / F.aggregate(all_scores, F.lit(0.0), lambda total, x: total + F.exp(x - F.col("top")))).alias("posterior"),
        F.when(F.col("n_words") > 0, F.element_at(lookup, F.array_position(all_logs, F.array_max(all_logs)).cast("int"))).otherwise(F.lit(UNDETERMINED)).alias("text_language"),
        "n_words",
        *(["tag"] if key_text else []),
    )
    return out.withColumn("accepted", (F.col("language") != UNDETERMINED) & (F.col("posterior") >= least))


def keep_identified(docs: DataFrame, model: TrigramBayes, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = None, markup_col: str | None = None, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose language is identified, with all their columns.

    Rows are told apart by id and text, so a null id is no obstacle and repeated rows stay or go
    together. Null and empty texts are decided by the other evidence; an empty table gives no rows.
    """
    out = identify_languages(docs, model, id_col, text_col, host_col, markup_col, least, key_text=True).where("not accepted")
    a, b = fresh(docs, "out_id", "out_tag")
    gone = out.select(column(id_col).alias(a), F.col("tag").alias(b)).distinct()
    rows = docs.join(gone, column(id_col).cast("long").eqNullSafe(F.col(a)) & (F.xxhash64(column(text_col)) == F.col(b)), "left_anti")
    return narrow(rows, docs.columns)


def pages_evidence(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, text, host, markup) of raw pages: text without scripts, styles, comments and tags; the host of the address; the language that the html tag declares."""
    html = F.coalesce(column(html_col), F.lit(""))
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return pages.select(
        column(id_col).alias(id_col),
        F.regexp_replace(text, r"&(#?\w+);", " ").alias("text"),
        F.nullif(F.regexp_extract(F.lower(column(url_col)), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")).alias("host"),
        F.nullif(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1), F.lit("")).alias("markup"),
    )
