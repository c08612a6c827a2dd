"""Operators on token tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, StructField, StructType


def token_counts(df: DataFrame, tokens: str = "tokens", ordered: bool = True) -> DataFrame:
    """(token, n), most frequent first, ties by token; in no order if ``ordered`` is false."""
    counts = df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "token") if ordered else counts


def token_tag_counts(df: DataFrame, tag: Column, tokens: str = "tokens") -> DataFrame:
    """(token, tag, n); ``tag`` is an expression of ``token``, such as one over a joined lexicon."""
    return df.select(F.explode(tokens).alias("token")).groupBy("token", tag.alias("tag")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token", "tag")


def casing_variants(counts: DataFrame) -> DataFrame:
    """(folded, variants, n) of tokens that differ in case only."""
    return counts.groupBy(F.lower("token").alias("folded")).agg(F.array_sort(F.collect_set("token")).alias("variants"), F.sum("n").alias("n")).where(F.size("variants") > 1)


#: a lexicon of so many changing tokens is handed to all tasks
LEXICON = 200_000


def lemmatise(df: DataFrame, lexicon: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """(key, lemmas) with each token's lemma from ``lexicon`` (token, lemma; tokens unique), or the token itself.

    The tokens that a lexicon changes are counted; up to LEXICON of them are looked up where the rows are,
    by batches of arrays, so no token is shuffled. More are joined with the distinct tokens of ``df`` first.
    """
    changing = lexicon.where((F.col("token").isNotNull()) & (F.col("lemma") != F.col("token"))).select("token", "lemma")
    few = changing.limit(LEXICON + 1).toArrow()
    if few.num_rows <= LEXICON:
        return _looked_up(df, few["token"].combine_chunks(), few["lemma"].combine_chunks(), key, tokens)
    long = df.select(key, F.posexplode(tokens).alias("pos", "token"))
    forms = long.select("token").distinct().join(changing, "token")
    looked = long.join(forms, "token", "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("lemma", "token").alias("lemma")))).alias("l"))
    return df.select(key).join(looked.select(key, F.transform("l", lambda x: x["lemma"]).alias("lemmas")), key, "left").withColumn("lemmas", F.coalesce("lemmas", F.array().cast("array<string>")))


def _looked_up(df: DataFrame, known: pa.Array, lemmas: pa.Array, key: str, tokens: str) -> DataFrame:
    """(key, lemmas) by a look-up of all tokens of a batch at once."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("lemmas")
            flat = lists.flatten()
            found = pc.coalesce(lemmas.take(pc.index_in(flat, value_set=known)), flat) if len(known) else flat
            sizes = pc.fill_null(pc.list_value_length(lists), 0)
            offsets = np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.ListArray.from_arrays(pa.array(offsets), found)], names=[key, "lemmas"])

    rows = df.select(key, F.col(tokens).alias("lemmas"))
    return rows.mapInArrow(look, StructType([df.schema[key], StructField("lemmas", ArrayType(StringType()))]))


def union_lists(*lists: DataFrame) -> DataFrame:
    """The distinct words of several lists."""
    out = lists[0].select("word")
    for other in lists[1:]:
        out = out.union(other.select("word"))
    return out.distinct()


def read_trees(trees: DataFrame, sentence: str = "sent", tree: str = "tree") -> tuple[DataFrame, DataFrame]:
    """(sent, pos, token) and (sent, label, start, end, depth, head) of bracketed parse trees such as ``(S (NP (DT the) (NN cat)) (VP (VB sat)))``.

    Spans are half-open and count tokens; the root has depth 0; ``head`` is the first token under a node,
    null for one without tokens. A null or blank tree has no nodes; brackets that close nothing end
    none, and nodes left open end with the sentence. Each sentence is swept once, where it is.
    """
    marks = trees.select(sentence, F.col(tree).alias("tree")).where("tree is not null")
    word, node = StructType([trees.schema[sentence], *StructType.fromDDL("pos int, token string")]), StructType([trees.schema[sentence], *StructType.fromDDL("label string, start int, end int, depth int, head string")])
    return marks.mapInArrow(_sweeper(_words, sentence, word), word), marks.mapInArrow(_sweeper(_nodes, sentence, node), node)


#: what a tree is read by: a bracket with its label, a closing bracket, a leaf
MARK = re.compile(r"\(\s*[^\s()]*|\)|[^\s()]+", re.ASCII)


def _words(marks: list[str]) -> Iterator[tuple]:
    """(pos, token) of the leaves."""
    return enumerate(m for m in marks if m != ")" and not m.startswith("("))


def _nodes(marks: list[str]) -> Iterator[tuple]:
    """(label, start, end, depth, head) of the nodes, as they end."""
    leaves, stack, level = [m for m in marks if m != ")" and not m.startswith("(")], [], 0
    at = 0

    def done(label: str, start: int, depth: int) -> tuple:
        return label, start, at, depth, leaves[start] if at > start else None

    for m in marks:
        if m.startswith("("):
            stack.append((m[1:].strip(" "), at, level))
            level += 1
        elif m == ")":
            level -= 1
            if stack and stack[-1][2] == level:
                yield done(*stack.pop())
        else:
            at += 1
    while stack:
        yield done(*stack.pop())


def _sweeper(sweep: Callable[[list[str]], Iterator[tuple]], sentence: str, schema: StructType) -> Callable:
    """Rows of ``schema`` from the marks of each sentence's tree, some thousand to a batch."""
    kinds, names = [f.type for f in to_arrow_schema(schema)], schema.names

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = ((s, *r) for s, marks in zip(b.column(sentence).to_pylist(), map(MARK.findall, b.column("tree").to_pylist())) for r in sweep(marks))
            while part := list(islice(rows, 20_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), kinds)], names=names)

    return swept


def outermost_spans(nodes: DataFrame, label: str, sentence: str = "sent") -> DataFrame:
    """Spans with ``label`` inside no other such span; for a sentence without any, its root. ``nodes`` is (sent, label, start, end, depth, ...), spans of a tree.

    One sweep of each sentence: by start, the longer and higher first, a span is inside another if it ends no later than any before it.
    """
    ahead = Window.partitionBy(sentence).orderBy(F.col("start"), F.col("end").desc(), F.col("depth")).rowsBetween(Window.unboundedPreceding, -1)
    hit = F.col("label") == label
    swept = nodes.withColumn("_reach", F.max(F.when(hit, F.col("end"))).over(ahead)).withColumn("_any", F.max(hit).over(Window.partitionBy(sentence)))
    outer = hit & (F.col("_reach").isNull() | (F.col("end") > F.col("_reach")))
    return swept.where(outer | (~F.col("_any") & (F.col("depth") == 0))).select(*nodes.columns)


def prune_spans(tokens: DataFrame, nodes: DataFrame, label: str, heads: Sequence[str], sentence: str = "sent") -> DataFrame:
    """Tokens (sent, pos, token) outside spans with ``label`` whose ``head``, lower-cased, is one of ``heads``.

    Tokens and spans are swept together by place: a token is in a span if one that begins up to it ends after it.
    """
    cut = nodes.where((F.col("label") == label) & F.lower("head").isin(*heads)).select(sentence, F.col("start").alias("pos"), F.col("end").alias("_end"), F.lit(0).alias("_kind"))
    both = tokens.withColumn("_kind", F.lit(1)).unionByName(cut, allowMissingColumns=True)
    upto = Window.partitionBy(sentence).orderBy("pos", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumn("_reach", F.max("_end").over(upto))
    return swept.where((F.col("_kind") == 1) & (F.col("_reach").isNull() | (F.col("_reach") <= F.col("pos")))).select(*tokens.columns)
