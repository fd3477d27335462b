"""Verbs of the command line: report, internal, wiki, bridge, sync, resolve, node, detect, extract, align."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cohera.operators import bridges, chunks, fim, graph, layout, report, vectors
from cohera.plans import runs
from cohera.sources import bundle, detect, parsers


def _session() -> SparkSession:
    return SparkSession.builder.appName("cohera").getOrCreate()


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="cohera", description=__doc__)
    verbs = p.add_subparsers(dest="verb", required=True)
    for name, args in {"report": ("bundle", "kb"), "internal": ("bundle",), "bridge": ("bundle", "kb"), "node": ("bundle", "node"), "detect": ("path",), "extract": ("path",), "align": ("bundle",), "wiki": ("kb",), "sync": ("bundle", "kb"), "resolve": ("kb", "claim")}.items():
        v = verbs.add_parser(name)
        for a in args:
            v.add_argument(a)
        v.add_argument("--alpha", type=float, default=1.0)
        v.add_argument("--min-sim", type=float, default=0.75)
        v.add_argument("--format", choices=("text", "json", "markdown", "html"), default="text")
    a = p.parse_args(argv)
    spark = _session()
    if a.verb == "detect":
        print(json.dumps(detect.detect_with_report(spark, a.path)))
        return
    if a.verb == "sync":
        kb = bundle.open_bundle(spark, a.kb)
        swept = fim.sweep(kb["entries"], graph.build_graph(kb["entries"], kb["links"]), alpha=a.alpha)
        print(json.dumps(runs.bridge_run(spark, a.bundle, kb, a.min_sim, kb_sweep=swept)))
        return
    if a.verb == "wiki":
        kb = bundle.open_bundle(spark, a.kb)
        out = report.tier1(fim.sweep(kb["entries"], graph.build_graph(kb["entries"], kb["links"]), alpha=a.alpha))
    elif a.verb == "resolve":
        kb = bundle.open_bundle(spark, a.kb)
        known = chunks.embed(chunks.embed_texts(kb["entries"], kb["sections"])).select(F.col("id").alias("chunk_id"), F.col("id").alias("entry_id"), "vec")
        asked = chunks.embed(spark.createDataFrame([(0, a.claim)], "id int, text string"), query=True).select("id", "vec")
        out = vectors.resolve_claims(asked, known)
    elif a.verb == "extract":
        out = layout.extract_to_claims(layout.full_text(parsers.read_pages(spark, a.path), "doc", "page"), "doc")
    else:
        b = bundle.open_bundle(spark, a.bundle)
        edges = graph.build_graph(b["entries"], b["links"])
        if a.verb == "internal":
            out = report.tier1(fim.sweep(b["entries"], edges, alpha=a.alpha))
        elif a.verb == "node":
            out = fim.analyze_node(b["entries"], edges, a.node, alpha=a.alpha)
        elif a.verb == "align":
            out = bridges.entry_alignment(bridges.aligned_bridges(b["entries"], b["links"], bundle.read_bridges(spark, a.bundle)))
        else:
            kb = bundle.open_bundle(spark, a.kb)
            if a.verb == "bridge":
                v, e = graph.bridge_graph(b["entries"], b["links"], kb["entries"], kb["links"], bundle.read_bridges(spark, a.bundle), a.min_sim)
                out = fim.sweep(v, e, alpha=a.alpha)
            else:
                out = report.generate(bundle.get_meta(spark, a.bundle).get("package_name", a.bundle), b["entries"], b["links"], kb["entries"], kb["links"], bundle.read_bridges(spark, a.bundle), a.min_sim, a.alpha)
    if a.format == "json":
        print(out.select(F.to_json(F.struct("*")).alias("j")).toPandas()["j"].str.cat(sep="\n"))
    elif a.format in ("markdown", "html"):
        print(getattr(report, a.format)(out.first()))
    else:
        print(report.text_table(out))


if __name__ == "__main__":
    main()
