"""Jobs from the command line: train a codebook, prepare a corpus.

    spark-submit vectide/jobs.py train --points P --out F --parts 64 --width 64 --centroids 256
    spark-submit vectide/jobs.py prepare --docs D --book B --out F --parts 64 --width 64

``--points`` are (doc_id, point_idx, vec), ``--docs`` (doc_id, points), ``--book``
(subspace, centroid, vec): parquet on any file system that Spark reads.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from vectide.functions.vectors import SubspaceSpec
from vectide.operators import quantize, retrieval
from vectide.sources import writers


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    train = jobs.add_parser("train")
    train.add_argument("--points", required=True)
    train.add_argument("--centroids", type=int, default=256)
    train.add_argument("--rounds", type=int, default=20)
    prepare = jobs.add_parser("prepare")
    prepare.add_argument("--docs", required=True)
    prepare.add_argument("--book", required=True)
    for job in (train, prepare):
        job.add_argument("--out", required=True)
        job.add_argument("--parts", type=int, default=64)
        job.add_argument("--width", type=int, default=64)
    o = parser.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    spec = SubspaceSpec(o.parts, o.width)
    if o.job == "train":
        points = spark.read.parquet(o.points)
        book = quantize.train(points, spec, o.centroids, o.rounds)
        writers.pq_store(book, quantize.packed_codes(quantize.encode(points, book, spec)), o.out)
    else:
        docs = spark.read.parquet(o.docs)
        corpus = retrieval.Corpus(docs, docs.limit(0).selectExpr("cast(0 as bigint) as query_id", "points"), spec)
        retrieval.prepare(corpus, spark.read.parquet(o.book)).save(o.out)


if __name__ == "__main__":
    main()
