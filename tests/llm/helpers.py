"""Small tables with the awkward rows that every operator must take."""

from random import Random

from pyspark.sql import functions as F

#: Names that the operators use inside.
CLASHES = ["id", "version", "hash", "row", "rows", "node", "fp", "second", "bucket", "copy", "size", "crc", "xx", "shard", "slot", "x", "y", "n", "at", "key", "tokens", "spans", "items", "tie", "place", "score", "lo", "hi", "weight"]


def sentence(r, low=3, high=12):
    return " ".join("".join(r.choice("abcdeiorstn") for _ in range(r.randint(1, 8))) for _ in range(r.randint(low, high))) + "."


def corpus(seed=0, n=40):
    """(doc_id, text): plain texts, copies, near copies, shared passages, nulls, empty ones, one long one, characters of several bytes."""
    r = Random(seed)
    texts = [" ".join(sentence(r) for _ in range(r.randint(1, 25))) for _ in range(n)]
    passage = " ".join(sentence(r, 8, 14) for _ in range(8))
    texts += [texts[0], texts[1], texts[1], texts[2].replace("a", "e", 1), texts[3][:-1], texts[4] + " " + passage, passage + " " + texts[5], passage, passage + passage]
    texts += [None, None, "", "", "   ", "Ünï cödé ñ 漢字 " * 3, "a", "a b", "A B", "one two three four five six seven eight nine ten eleven twelve"]
    texts.append(" ".join(sentence(r) for _ in range(1500)))
    texts.append("in " * 400)
    return list(enumerate(texts))


def documents(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    df = df.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, "en")).withColumn("source", F.concat(F.lit("src"), F.col("doc_id") % 2)).withColumn("n_chars", F.char_length("text").cast("long"))
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


def empty(spark):
    return documents(spark, [])


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
