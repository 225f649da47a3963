"""Command line over the engine: ``python -m folia.cli <command>``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from folia import catalog
from folia.sources import settings

PAGES = "doc_id string, page_no int, width_px int, height_px int, dpi double, native boolean, ink double, raw_sha256 string, gray_sha256 string"
LINES = "doc_id string, page_no int, region_id string, line_id string, line_index int, x long, y long, w long, h long, text string"


def session(name: str = "folia") -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="folia")
    commands = parser.add_subparsers(dest="command", required=True)

    def add(name: str, help: str, *places: str):
        c = commands.add_parser(name, help=help)
        for p in places:
            c.add_argument(p)
        return c

    add("queries", "list the registered queries")
    add("run", "run a registered query", "query", "tables").add_argument("--out", help="write Parquet here instead of showing rows")
    add("config", "show a profile as TOML").add_argument("name", nargs="?")
    add("providers", "list the transcription providers")
    add("corpus", "count a corpus file's verses and chapters", "path")
    add("ingest", "page images (<page number>.png) into a store", "images", "store").add_argument("--max-pages", type=int)
    extract = add("extract", "transcribe a document's pages into lines", "store", "doc")
    extract.add_argument("--provider", default="stub")
    extract.add_argument("--pages", type=int, nargs="*")
    add("ls", "list the documents, the latest first", "store").add_argument("--json", action="store_true")
    add("show", "a document's runs", "store", "doc")
    add("text", "write a document's text in reading order", "store", "doc", "out")
    add("dump", "write a document's lines as JSON", "store", "doc", "out")
    add("load", "read lines from JSON into a store", "store", "path")
    add("render", "write a document's pages as HTML", "store", "doc", "out")
    return parser


def _lines(store, doc: str):
    return store.read("lines", LINES).where(F.col("doc_id") == doc)


def _regions(lines):
    from folia.operators import document as D

    each = lines.select("doc_id", "page_no", "region_id").distinct()
    plain = each.select("*", F.col("region_id").alias("raw"), F.lit(1).alias("columns"), F.lit(0).alias("column_index"), F.lit("unknown").alias("region_type"))
    return D.reading_positions(plain, plain.limit(0).select("doc_id", "page_no", "region_id", F.lit(0).alias("place")))


def ingest(store, images: str, max_pages: int | None = None):
    """Pages of a folder of PNG files; the document is named by the digests of its images."""
    from folia.sources.images import ingest as put
    from folia.sources.tables import read_page_images

    files = read_page_images(store.spark, images)
    source = files.agg(F.sha2(F.concat_ws("", F.sort_array(F.collect_list("sha256"))), 256)).first()[0]  # of one document's pages
    named = files.select(F.lit(images).alias("source_path"), F.lit(source).alias("source_sha256"), F.regexp_extract("path", r"([0-9]+)\.png$", 1).cast("int").alias("page_no"), "bytes", F.lit(None).cast("double").alias("placed_points"), F.lit(True).alias("native"))
    pages = put(store, named.where("page_no IS NOT NULL"), max_pages)
    store.append("pages", pages.select(*[c.split()[0] for c in PAGES.split(", ")]))
    return pages


def extract(store, doc: str, spec: str = "stub", pages: list[int] | None = None) -> None:
    """Transcribe rows of a document's pages; lines take the boxes of the rows."""
    import numpy as np
    import pandas as pd

    from folia.operators.document import only_pages
    from folia.sources.images import from_png
    from folia.sources.providers import provider, stub_rows

    wanted = only_pages(store.read("pages", PAGES).where(F.col("doc_id") == doc), pages)
    images = wanted.join(store.read("blobs").select(F.col("sha256").alias("gray_sha256"), "bytes"), "gray_sha256")

    def run(batches):
        client = provider(spec)
        for b in batches:
            out = []
            for page, raw in zip(b.page_no, b.bytes, strict=True):
                gray = from_png(bytes(raw))
                rows = stub_rows(gray)
                said = client.transcribe(gray, [f"p{page:03d}l{i:03d}" for i in range(len(rows))])
                for i, ((line, text), (y0, y1)) in enumerate(zip(said, rows, strict=True)):
                    dark = np.flatnonzero((gray[y0 : y1 + 1] < 128).any(axis=0))
                    x0, x1 = (int(dark[0]), int(dark[-1]) + 1) if len(dark) else (0, gray.shape[1])
                    out.append((doc, page, f"p{page:03d}r000", line, i, x0, y0, x1 - x0, y1 - y0 + 1, text))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LINES.split(", ")])

    store.append("lines", images.select("page_no", "bytes").mapInPandas(run, LINES))


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "queries":
        print("\n".join(sorted(catalog.queries())))
    elif args.command == "config":
        print(settings.to_toml(settings.load_profile(args.name)))
    elif args.command == "providers":
        from folia.sources.providers import REGISTRY

        print("\n".join(sorted(REGISTRY)))
    elif args.command == "run":
        got = catalog.queries()[args.query](session(), args.tables)
        got.write.mode("error").parquet(args.out) if args.out else got.show(truncate=False)
    elif args.command == "corpus":
        from folia.sources.tables import read_corpus

        verses = read_corpus(session(), args.path)
        print(json.dumps({"verses": verses.count(), "chapters": verses.select("a").distinct().count()}))
    else:
        _store_command(args)
    return 0


def _store_command(args) -> None:
    from folia.operators import document as D
    from folia.plans import ledger as G
    from folia.plans.store import Store
    from folia.sources import render as H

    store = Store(session(), args.store)
    if args.command == "ingest":
        for r in ingest(store, args.images, args.max_pages).groupBy("doc_id").count().collect():
            print(f"{r.doc_id} {r['count']} page(s)")
        return
    if args.command == "ls":
        rows = [r.asDict() for r in G.listing(store.documents()).collect()]
        print(json.dumps(rows, default=str) if args.json else "\n".join(f"{r['doc_id']}  {str(r['updated_at'])[:19]}  {r['source_path']}" for r in rows))
        return
    if args.command == "load":
        store.append("lines", store.spark.read.schema(LINES).option("mode", "FAILFAST").json(args.path))
        return
    doc = G.resolve(store.documents().select("doc_id").union(store.read("lines", LINES).select("doc_id")), args.doc)
    if args.command == "show":
        print("\n".join(f"{r.run_id} {r.stage} {r.stage_version} {r.status}" for r in store.runs(doc).collect()))
    elif args.command == "extract":
        extract(store, doc, args.provider, args.pages)
    elif args.command == "dump":
        _lines(store, doc).orderBy("page_no", "line_index").write.mode("error").json(args.out)
    else:
        lines = _lines(store, doc)
        if args.command == "text":
            D.text_dump(D.region_texts(lines, _regions(lines))).orderBy("page_no").select("text").coalesce(1).write.mode("error").text(args.out, lineSep="\n\n")
        else:
            pages = store.read("pages", PAGES).where(F.col("doc_id") == doc).select("doc_id", "page_no", F.col("width_px").alias("width"), F.col("height_px").alias("height"))
            H.documents(H.debug_pages(pages, lines, _regions(lines)), ["page_no"]).select("html").write.mode("error").text(args.out)


if __name__ == "__main__":
    raise SystemExit(main())
