"""Groups of spelling variants by asymmetric chunks.

Two words are near if one inserted, deleted or replaced code point makes one of the other. Of a pair the shorter word
(the smaller of equal ones) contributes two disjoint chunks of half its length, the other all its positional grams of
that length. One edit leaves one of the chunks whole, moved by one place at most, so near words share a chunk and a gram
within shift one. They are joined on string, length and place: a gram stands for the chunk places from one before it to
one behind, and grams that are further than that from any chunk are not sent. What is left beside an unharmed chunk holds
the one edit, so its first half or its last is whole too and joins the key: of 795,000 words of 0.5 GB, chunks alone met
872 million grams. Joined pairs are verified by edit distance in the same stage, so that only near pairs are written.

Words are counted in each task before they are shuffled; all else is a join or an aggregation of Spark. The
vocabulary is written once, and a chunk that many words share is a hot key of a plain join of two exchanges, which
adaptive execution splits; words are never sent to the driver or broadcast. A word has at most some 200 near words a code point (the alphabet bounds them), and forms at
least double in count, so chains of forms end within 63 steps and pointers that double their reach within six rounds.

Defined cases: null texts and texts without letters have no words; a null doc_id is an empty string in the hash; repeated
rows count each; of near words with equal counts the smaller in code-point order is the form; an empty table gives an
empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import bounded, slices, utf8
from cairn.session import table
from cairn.storage import store

#: Code points of a word and its occurrences, at least; a run whose hash this divides loses a code point; how many times
#: as frequent as a word its form is, at least.
SHORTEST, RAREST, SLIP, TIMES = 5, 3, 97, 2

#: Distinct words that a task counts before it sends what it has.
HELD_WORDS = 500_000
_RUN = re.compile("[A-Za-z\u00C0-\u00FF]+")


def counted(ids: list, texts: list[bytes], into: Counter) -> None:
    """Adds the words of texts: runs of letters, lower-cased (A-Z), with a code point less where their hash says so."""
    for doc_id, text in zip(ids, texts, strict=True):
        start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
        for run, n in Counter(_RUN.findall(text.lower().decode())).items():
            if len(run) < SHORTEST:
                continue
            h = zlib.crc32(run.encode(), start)
            if not h % SLIP:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < SHORTEST:
                    continue
            into[run] += n


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of each task's part of the texts, in parts of HELD_WORDS words or a little more."""

    def sent(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()
        for batch in batches:
            for part in slices(batch):
                counted(part.column("id").to_pylist(), utf8(part), held)
                if len(held) > HELD_WORDS:
                    yield sent(held)
                    held = Counter()
        yield sent(held)

    return bounded(docs.select(F.col("doc_id").alias("id"), "text")).mapInArrow(run, "word string, n bigint")


def vocabulary(docs: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(word, n) of the words that occur ``rarest`` times or more."""
    return word_counts(docs).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rarest)


def _half(size: str) -> str:
    return f"({size} div 2)"


def _ends(at: str) -> str:
    """What is left beside the piece at ``at``: its beginning and its end, of which one edit leaves one whole."""
    half = _half("size")
    rest, left = f"concat(substring(word, 1, {at}), substring(word, {at} + {half} + 1))", f"((size - {half}) div 2)"
    return f"explode(array(concat('<', substring({rest}, 1, {left})), concat('>', right({rest}, size - {half} - {left}))))"


def chunks(words: DataFrame) -> DataFrame:
    """(short, short_n, size, place, piece, end): the two disjoint halves of each word, of ``size`` code points."""
    half = _half("size")
    places = words.withColumn("size", F.char_length("word")).withColumn("place", F.expr(f"explode(array(0, {half}))"))
    return places.select(F.col("word").alias("short"), F.col("n").alias("short_n"), "size", "place", F.expr(f"substring(word, place + 1, {half})").alias("piece"), F.expr(_ends("place")).alias("end"))


def grams(words: DataFrame) -> DataFrame:
    """(long, long_n, size, place, piece, end): all positional grams that a chunk of a word of ``size`` may meet.

    ``size`` is the length of this word or one less, as that of the other word of a pair may be; ``place`` is that of a
    chunk within one of the gram's own.
    """
    half = _half("size")
    sizes = words.withColumn("size", F.expr(f"explode(filter(array(char_length(word), char_length(word) - 1), s -> s >= {SHORTEST}))"))
    at = sizes.withColumn("gram", F.expr(f"explode(sequence(0, char_length(word) - {half}))"))
    met = at.withColumn("place", F.expr(f"explode(filter(array(0, {half}), p -> abs(p - gram) <= 1))"))
    return met.select(F.col("word").alias("long"), F.col("n").alias("long_n"), "size", "place", F.expr(f"substring(word, gram + 1, {half})").alias("piece"), F.expr(_ends("gram")).alias("end"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(short, short_n, long, long_n): each pair of near words of (word, n), once."""
    # Never a broadcast: sizes are judged by the vocabulary, of which each word is up to twenty rows here.
    met = chunks(words).hint("merge").join(grams(words).hint("merge"), ["size", "place", "piece", "end"])
    ordered = (F.col("size") < F.char_length("long")) | (F.col("short") < F.col("long"))
    near = met.where(ordered & (F.levenshtein("short", "long", 1) == 1))
    return near.groupBy("short", "long").agg(F.first("short_n").alias("short_n"), F.first("long_n").alias("long_n"))


def forms(words: DataFrame, pairs: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n) of each word."""
    both = F.explode(F.array(F.struct(F.col("short").alias("word"), F.col("long").alias("near"), F.col("long_n").alias("near_n")), F.struct(F.col("long").alias("word"), F.col("short").alias("near"), F.col("short_n").alias("near_n"))))
    sides = pairs.select(both.alias("side")).select("side.*")
    # The largest count first, then the smallest word: the least of (-count, word).
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.hint("merge").join(best, "word", "left").withColumn("is_form", F.expr(f"-best.less >= {times} * n"))
    return joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.expr("if(is_form, best.near, null)").alias("form"), F.expr("if(is_form, -best.less, null)").alias("form_n"),
    )


def with_roots(rows: DataFrame) -> DataFrame:
    """``rows`` of ``forms`` with the word that following forms ends at; each round doubles how far a pointer reaches."""
    at = store(rows.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while at.df.where("moved").limit(1).count():
        onward = at.df.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = at.df.select("word", "root").hint("merge").join(onward, "root", "left")
        moved = store(moved.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        at.remove()
        at = moved
    return rows.hint("merge").join(at.df.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of the texts."""
    words = store(vocabulary(docs), "vocabulary")
    rows = store(forms(words.df, near_pairs(words.df)), "near")
    return with_roots(rows.df).select("word", "form", "root", "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents", spread=True))


#: CRC-32 byte by byte; near words are alike when the code point at one place is taken out of both, or of one alone.
_SQL = r"""
with recursive bits(b, k, v) as (
  select range, 0, range::bigint from range(256)
  union all
  select b, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8),
steps as (select list(v order by b) t from bits where k = 8),
runs as (
  select coalesce(doc_id::varchar, '') id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) run
  from documents),
per as (select id, run, count(*) k, hex(encode(id || ':' || run)) hx from runs where length(run) >= 5 group by id, run),
hashed as (
  select run, k, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, len(hx) + 1, 2), lambda i: ('0x' || substr(hx, i, 2))::bigint)),
    lambda a, c: xor(t[(xor(a, c) & 255) + 1], a >> 8)), 4294967295) h
  from per, steps),
slipped as (
  select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end word, k from hashed),
words as (select word, sum(k)::bigint n from slipped where length(word) >= 5 group by word having sum(k) >= 3),
less as (
  select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) rest
  from (select word, n, unnest(range(1, length(word) + 1)) i from words)
  union all select word, n, 0, word from words),
pairs as (
  select distinct a.word, b.word near, b.n near_n from less a join less b using (rest)
  where a.word <> b.word and (a.i = b.i or a.i = 0 or b.i = 0)),
best as (
  select word, count(*) n_near, arg_min(near, (-near_n, near)) near, max(near_n) near_n from pairs group by word),
forms as (
  select w.word, n, coalesce(n_near, 0)::bigint n_near, case when near_n >= 2 * n then near end form, case when near_n >= 2 * n then near_n end form_n
  from words w left join best using (word)),
chain(word, reached, step) as (
  select word, word, 0 from forms
  union all
  select c.word, f.form, step + 1 from chain c join forms f on f.word = c.reached where f.form is not null),
roots as (select word, arg_max(reached, step) root from chain group by word)
select word, form, root, n, n_near, form_n from forms join roots using (word)
"""

QUERIES = {"op11_spelling_variants": op11_spelling_variants}
ORACLES = {"op11_spelling_variants": _SQL}
