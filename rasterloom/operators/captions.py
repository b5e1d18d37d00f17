"""Caption corpora: cleaning, indexes, relevance relations, token rows, masks and negative draws."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from rasterloom.functions.storage import before, in_ranges

CLS, SEP, PAD, MASK, FIRST_WORD = 101, 102, 0, 103, 103
TARGET_NONE = -100
#: What Python's ``\s`` matches in a text, for a character class; Java's is ASCII only.
SPACE = r"\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
MARKS = ",.'!?\"()*#:;~"


def clean_caption(caption: Column, most_words: int = 30) -> Column:
    """Lower case without ``,.'!?"()*#:;~``; - and / become spaces, runs of white space one space; at most so many words.

    Words are what single spaces part; a lone tab or newline inside stays.
    """
    t = F.translate(F.lower(caption), MARKS, "")
    t = F.replace(F.translate(t, "-/", "  "), F.lit("<person>"), F.lit("person"))
    t = F.regexp_replace(t, rf"[{SPACE}]{{2,}}", " ")
    t = F.trim(F.rtrim(t, F.lit("\n")), F.lit(" "))
    return F.array_join(F.slice(F.split(t, " "), 1, most_words), " ")


def stripped(text: Column) -> Column:
    """Text without white space at its ends; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"^[{SPACE}]+|[{SPACE}]+$", "")


def entry_text(text: Column, parts: Column, phrases: Column, summary: Column, fallback: str = "") -> tuple[Column, Column]:
    """An entry's text and its distinct phrases in order.

    The text is ``text``, or ``parts`` (an array) joined by " ; " where that is given instead; without
    either the summary, then the joined phrases, then the fallback. Phrases are the parts and the
    phrases that are not blank.
    """
    clean = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), stripped), lambda x: x != "")
    given = F.when(parts.isNotNull(), F.array_join(clean(parts), " ; ")).otherwise(stripped(text))
    all_ = F.concat(clean(parts), clean(phrases))
    found = F.when(given != "", given).when(stripped(summary) != "", stripped(summary)).when(F.size(all_) > 0, F.array_join(all_, " ; ")).otherwise(F.lit(fallback))
    return found, F.array_distinct(all_)


def not_blank(caption: Column) -> Column:
    """Whether anything but spaces and the marks ``,.'!?"()*#:;~`` is there."""
    return F.trim(F.translate(caption, MARKS, "")) != ""


def pairs(corpus: DataFrame, image: str = "image_id", captions: str = "captions") -> DataFrame:
    """A row per (image, caption): pos from 0, caption, and whether it is a replica (not the image's first)."""
    keep = [c for c in corpus.columns if c != captions]
    return corpus.select(*keep, F.posexplode(captions).alias("pos", "caption")).withColumn("replica", F.col("pos") > 0)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Dense numbers from 0 in the given order over the whole table.

    Rows are dealt by ranges of the order; each range is numbered by itself and then raised by the
    rows of the ranges before it, so no task has all rows.
    """
    d = in_ranges(df, order)
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    start = before(d, F.count(F.lit(1)), "_b")
    return d.withColumn("_i", own).join(F.broadcast(start), "_p").withColumn(name, F.col("_i") + F.col("_b")).drop("_p", "_i", "_b")


def caption_index(corpus: DataFrame, image: str = "image_id") -> DataFrame:
    """Every (image, caption place) with a running index in the order of images."""
    return numbered(pairs(corpus, image).select(image, "pos"), [image, "pos"], "index")


def dense_ids(df: DataFrame, value: str, order: list[str], name: str) -> DataFrame:
    """Equal values share a number, given by first appearance; a row per distinct value."""
    first = df.groupBy(value).agg(F.min(F.struct(*order)).alias("_f"))
    flat = first.select(value, *[F.col(f"_f.{o}").alias(f"_{o}") for o in order])
    return numbered(flat, [f"_{o}" for o in order], name).drop(*[f"_{o}" for o in order])


def relevance(p: DataFrame, ids: DataFrame, distinct: bool, image: str = "image_id", text: str = "caption") -> DataFrame:
    """Edges image to text id, with repeats by place (evaluation), or distinct (training)."""
    e = p.join(ids, text).select(image, "pos", "text_id")
    return e.select(image, "text_id").distinct() if distinct else e


def context_text(text: Column, summary: Column, phrases: Column, mode: str, fallback: str, budget: int) -> Column:
    """Context by mode (phrases, summary, concat or any), else the fallback; cut to so many words."""
    text, summary = F.trim(F.coalesce(text, F.lit(""))), F.trim(F.coalesce(summary, F.lit("")))
    own = F.filter(F.transform(F.coalesce(phrases, F.array().cast("array<string>")), lambda p: F.trim(p)), lambda p: p != "")
    joined = F.array_join(own, " ; ")
    extra = F.when((summary != "") & ~F.contains(F.lower(text), F.lower(summary)), summary)
    every = F.array_join(F.array_distinct(F.concat(F.array_compact(F.array(F.nullif(text, F.lit("")), extra)), own)), " ; ")
    rest = F.coalesce(F.nullif(text, F.lit("")), F.nullif(summary, F.lit("")), F.nullif(joined, F.lit("")))
    main = {"phrases": F.coalesce(F.nullif(joined, F.lit("")), rest), "summary": F.coalesce(F.nullif(summary, F.lit("")), rest), "concat": every}.get(mode, rest)
    words = F.filter(F.split(F.coalesce(F.nullif(main, F.lit("")), F.lit(fallback)), r"\s+"), lambda w: w != "")
    return F.array_join(F.slice(words, 1, budget), " ")


def first_entry(patches: DataFrame, entries: DataFrame, candidates: list[Column], key: str, entry_key: str, entry: str) -> DataFrame:
    """For each patch the entry of its first candidate name that has one; null if none has."""
    c = patches.select(key, F.posexplode(F.array(*candidates)).alias("_rank", "_name"))
    found = c.join(entries.select(F.col(entry_key).alias("_name"), F.col(entry).alias("_e")), "_name").groupBy(key).agg(F.min_by("_e", "_rank").alias(entry))
    return patches.join(found, key, "left")


#: Words whose ids a task keeps at most.
KEPT_WORDS = 500_000


def word_ids(vocabulary: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches with ``_w``, lists of words, as lists of their ids: 103 plus the word's 8-byte BLAKE2b digest modulo the rest of the vocabulary."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}

        def one(w: str) -> int:
            if w not in known:
                if len(known) >= KEPT_WORDS:
                    known.clear()
                known[w] = FIRST_WORD + int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") % (vocabulary - FIRST_WORD)
            return known[w]

        for batch in batches:
            at = batch.schema.get_field_index("_w")
            words = batch.column(at)
            flat = words.flatten().dictionary_encode()
            ids = pa.array([one(w) for w in flat.dictionary.to_pylist()], pa.int32()).take(flat.indices)
            ends = pc.cumulative_sum(pc.list_value_length(words).cast(pa.int32()))
            lists = pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), ids)
            yield pa.RecordBatch.from_arrays([lists if n == at else c for n, c in enumerate(batch.columns)], names=batch.schema.names)

    return mapped


def token_rows(df: DataFrame, key: str | list[str], text: str, length: int, vocabulary: int = 30522) -> DataFrame:
    """(key, pos, token) of each text: CLS, hashed words, SEP if it fits, PAD up to the length, with the attention mask.

    Words are runs of ASCII letters, digits and _; of the rest, all but letters, numbers and white space are words of their own.

    A word's id is that of ``word_ids``: an Arrow batch hashes each distinct word once, and no word is
    shuffled. A text is read once.
    """
    key = [key] if isinstance(key, str) else key
    words = df.select(*key, F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(rf"([A-Za-z0-9_]+|[^\p{{L}}\p{{N}}_{SPACE}])"), 1).alias("_w"))
    cut = words.select(*key, F.slice("_w", 1, max(0, length - 2)).alias("_w"))
    ids = cut.mapInArrow(word_ids(vocabulary), StructType([*cut.schema.fields[:-1], StructField("_w", ArrayType(IntegerType()))]))
    real = F.concat(F.array(F.lit(CLS)), "_w", F.array(F.lit(SEP)), F.array_repeat(F.lit(PAD), length))
    return ids.select(*key, F.posexplode(F.slice(real, 1, length)).alias("pos", "token")).withColumn("attention", (F.col("token") != PAD).cast("int"))


def masked_tokens(tokens: DataFrame, key: str, u: Column, kind: Column, draw: Column, probability: Column | float, vocabulary: int = 30522) -> DataFrame:
    """Masked-token rows: chosen places (never PAD or CLS) are 80 % MASK, 10 % another id, 10 % as they were; targets elsewhere are -100.

    ``u``, ``kind`` and ``draw`` are seeded uniforms of the row, so that a run can be repeated.
    """
    p = F.lit(probability) if isinstance(probability, float) else probability
    chosen = (u < p) & ~F.col("token").isin(PAD, CLS)
    new = F.when(~chosen, F.col("token")).when(kind < 0.8, MASK).when(kind < 0.9, F.floor(draw * vocabulary).cast("int")).otherwise(F.col("token"))
    return tokens.select(key, "pos", new.alias("input"), F.when(chosen, F.col("token")).otherwise(TARGET_NONE).alias("target"))


def exact_mask(images: DataFrame, key: str, cells: int, ratio: float, u: Column, repeat: int) -> DataFrame:
    """Exactly ceil(ratio * cells) masked cells of each image's square grid, each cell repeated to patches."""
    side = round(cells**0.5)
    k = -(-int(round(ratio * cells * 1_000_000)) // 1_000_000)
    c = images.select(key, F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
    r = F.row_number().over(Window.partitionBy(key).orderBy(u, "cell"))
    c = c.withColumn("masked", (r <= k).cast("int"))
    steps = F.sequence(F.lit(0), F.lit(repeat - 1))
    c = c.withColumn("_dy", F.explode(steps)).withColumn("_dx", F.explode(steps))
    py = F.floor(F.col("cell") / side) * repeat + F.col("_dy")
    px = F.col("cell") % side * repeat + F.col("_dx")
    return c.select(key, py.cast("int").alias("py"), px.cast("int").alias("px"), "masked")


def answer_vocabulary(rows: DataFrame, answer: str, label: str, order: list[str]) -> DataFrame:
    """Label of each answer; the last of its pairs wins."""
    return rows.groupBy(answer).agg(F.max_by(label, F.struct(*order)).alias(label))


def negative_draws(df: DataFrame, key: str, index: str, n: int, total: DataFrame, uniform: "callable") -> DataFrame:
    """n draws for each row of another row's index (its own may come up), by seeded hashes; targets come by an equi-join on the index."""
    d = df.select(key, index, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw")).join(F.broadcast(total))
    return d.withColumn("target", F.floor(uniform(F.col(key), F.col("draw")) * F.col("total"))).drop("total")
