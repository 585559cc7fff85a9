"""Command lines over GeoJSON collections: ``python -m netloom audit|rules|reach|solve|preview …``.

Each is a small Spark job: rows to the screen, files to a folder. A session may be configured by ``spark-submit`` as usual.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import audit, planning
from .sources import district, geojson


def _shown(df: DataFrame, limit: int) -> int:
    """Print the first rows as JSON lines; the number of rows."""
    for r in df.limit(limit).toJSON().collect():
        print(r)
    return df.count()


def _source(spark: SparkSession, path: str) -> DataFrame:
    return geojson.checked(geojson.read_features(spark, path))


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    match args.command:
        case "rules":  # what is wrong with an input
            return min(1, _shown(geojson.input_violations(geojson.read_features(spark, args.input)), args.limit))
        case "input":  # counts, penalty bound and hashes of an input
            _shown(geojson.input_audit(spark, args.input), args.limit)
        case "audit":  # what is wrong with an export
            return min(1, _shown(audit.audit(audit.read_export(spark, args.export), _source(spark, args.input)), args.limit))
        case "reach":  # consumers that no plan of their own reaches
            nodes, edges = district.graph(_source(spark, args.input), args.radius, args.per_sector)
            return min(1, _shown(planning.reachability(edges, nodes).filter("not reachable"), args.limit))
        case "solve":  # designs for every territory, ranked
            nodes, edges = district.graph(_source(spark, args.input), args.radius, args.per_sector)
            pipes, plans = planning.designs(edges, nodes, tuple(args.factors))
            pipes.write.mode("overwrite").json(f"{args.out}/pipes")
            plans.write.mode("overwrite").json(f"{args.out}/plans")
            _shown(spark.read.schema(plans.schema).json(f"{args.out}/plans").orderBy("territory", "rank"), args.limit)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="netloom", description=__doc__.splitlines()[0])
    p.add_argument("--limit", type=int, default=100, help="rows to print")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("rules", "input"):
        sub.add_parser(name).add_argument("input")
    a = sub.add_parser("audit")
    a.add_argument("input")
    a.add_argument("export")
    for name in ("reach", "solve"):
        s = sub.add_parser(name)
        s.add_argument("input")
        s.add_argument("--radius", type=float, default=120.0)
        s.add_argument("--per-sector", type=int, default=3)
    s.add_argument("--out", required=True)
    s.add_argument("--factors", type=json.loads, default=list(planning.FACTORS), help="weights of the roots' prices, one design each")
    return p


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return run(args, SparkSession.builder.appName(f"netloom {args.command}").getOrCreate())


if __name__ == "__main__":
    sys.exit(main())
