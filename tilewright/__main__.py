"""python -m tilewright extract --slides PATTERN... --export_dir DIR"""

from __future__ import annotations

import argparse
import importlib
import logging
import os
import sys
import time


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tilewright")
    commands = p.add_subparsers(dest="command", required=True)
    e = commands.add_parser("extract", help="find, outline and classify the cells of slides")
    e.add_argument("--slides", nargs="+", required=True, help="paths, patterns or urls")
    e.add_argument("--export_dir", "-e", required=True, help="where documents, settings and statuses go")
    e.add_argument("--tile_size", type=int, default=224, help="size of the tiles in the documents")
    e.add_argument("--n_tiles", type=int, default=None, help="first tiles of each slide only; all by default")
    e.add_argument("--n_workers", type=int, default=4, help="tasks at a time, in local mode")
    e.add_argument("--batch_size", type=int, default=8, help="windows that a model gets at once")
    e.add_argument("--verbose", type=int, default=0, help="above 0: print the statuses")
    e.add_argument("--provider", default="tilewright.sources.maps:Discs", help="module:Class of the model's maps; a class with `of` is made from each standard descriptor")
    e.add_argument("--maps", default=None, help="keep raw maps there until documents are written, and go on from those of a run that broke off")
    e.add_argument("--decoder", default="tilewright.sources.slides:Auto", help="module:Class that opens slides")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    from pyspark.sql import SparkSession

    from . import models
    from .plans.extract import extract
    from .sources.files import write_settings
    from .sources.shared import ship

    spark = SparkSession.builder.appName("tilewright").getOrCreate() if SparkSession.getActiveSession() else SparkSession.builder.master(f"local[{a.n_workers}]").appName("tilewright").getOrCreate()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", a.batch_size)
    ship(spark)
    os.makedirs(a.export_dir, exist_ok=True)
    write_settings(os.path.join(a.export_dir, "config.yaml"), vars(a), " ".join(sys.argv))
    module, _, cls = a.provider.partition(":")
    made = getattr(importlib.import_module(module), cls)
    if hasattr(made, "of"):
        for d in models.STANDARD.values():
            models.register(d, made.of)
        provider = [models.provider(name) for name in models.STANDARD]
    else:
        provider = made()
    logging.basicConfig(filename=os.path.join(a.export_dir, "run.log"), format="%(asctime)s %(levelname)s %(message)s", level=logging.INFO, force=True)
    log = logging.getLogger("tilewright")
    log.info("extract %s", vars(a))
    start = time.perf_counter()
    _, status = extract(spark, a.slides, a.export_dir, provider, decoder=a.decoder, tile=a.tile_size, n_tiles=a.n_tiles, batch=a.batch_size, maps_at=a.maps)
    rows = status.collect()
    for r in rows:
        log.log(logging.ERROR if r.status == "failed" else logging.INFO, "%s: %s %s %s (%s)", *r)
    log.info("%d slides in %.1f s", len(rows), time.perf_counter() - start)
    with open(os.path.join(a.export_dir, "status.csv"), "w", encoding="utf-8") as f:
        f.writelines(",".join(str(x or "") for x in r) + "\n" for r in rows)
    if a.verbose:
        for r in rows:
            print(*r)
    return int(any(r.status == "failed" for r in rows))


if __name__ == "__main__":
    sys.exit(main())
