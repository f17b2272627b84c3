"""Command line: ``python -m skyloom [options] INPUT`` reads a catalogue, detects streams and writes CSV files."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from skyloom import __version__
from skyloom.config import DetectConfig
from skyloom.operators.patches import patch_summary
from skyloom.plans.detect import detect
from skyloom.session import local_session, ship_package
from skyloom.sources.catalog import read_catalog
from skyloom.sources.sinks import report, write_named_files, write_summary

#: Candidates whose members are written, a file for each.
TOP = 20


def parser() -> argparse.ArgumentParser:
    d = DetectConfig()
    p = argparse.ArgumentParser("skyloom", description="Find thin co-moving streams of stars in a CSV, Parquet or FITS catalogue.")
    p.add_argument("input")
    p.add_argument("-v", "--version", action="version", version=f"skyloom {__version__}")
    p.add_argument("-o", "--output", default="./output", help="output folder")
    p.add_argument("-p", "--patch-radius", type=float, default=d.patch_radius, help="degrees")
    p.add_argument("-b", "--min-b", type=float, default=d.min_galactic_b, help="least Galactic latitude of patches, either side")
    p.add_argument("-s", "--sig-cut", type=float, default=d.significance_cut)
    p.add_argument("-k", "--knn", type=int, default=None, help="neighbours of the nearest-neighbour score")
    p.add_argument("-H", "--histogram", action="store_true", help="score by histograms instead of neighbours")
    p.add_argument("-q", "--quiet", action="store_true")
    for name in ("ra", "dec", "dist"):
        for end in ("min", "max"):
            p.add_argument(f"--{name}-{end}", type=float, default=getattr(d, f"{name}_{end}"))
    p.add_argument("--use-distance", action="store_true")
    p.add_argument("--use-rv", action="store_true")
    p.add_argument("--sky-bandwidth", type=float, default=d.min_sky_bandwidth)
    p.add_argument("--no-scores", action="store_true", help="leave member scores at 0")
    p.add_argument("--master", default=None, help="Spark master; local threads if neither this nor a running session gives one")
    return p


def config(a: argparse.Namespace) -> DetectConfig:
    more = {} if a.knn is None else {"knn_k": a.knn}
    return DetectConfig(
        patch_radius=a.patch_radius, min_galactic_b=a.min_b, significance_cut=a.sig_cut, ra_min=a.ra_min, ra_max=a.ra_max, dec_min=a.dec_min, dec_max=a.dec_max,
        dist_min=a.dist_min, dist_max=a.dist_max, use_distance=a.use_distance, use_rv=a.use_rv, min_sky_bandwidth=a.sky_bandwidth, **more,
    )


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    say = (lambda *x: None) if a.quiet else print
    spark = SparkSession.getActiveSession() or (SparkSession.builder.master(a.master).getOrCreate() if a.master else local_session(os.cpu_count() or 8))
    ship_package(spark)
    cfg = config(a)
    stars = read_catalog(spark, a.input)
    say(f"Input: {a.input}\nOutput: {a.output}\nCuts: RA {cfg.ra_min:g} to {cfg.ra_max:g}, Dec {cfg.dec_min:g} to {cfg.dec_max:g}, distance {cfg.dist_min:g} to {cfg.dist_max:g}")
    if stars.isEmpty():
        print("no star in the catalogue", file=sys.stderr)
        return 1
    run = detect(stars, cfg, None if a.no_scores else "histogram" if a.histogram else "knn")
    if run.star_patch.isEmpty():
        print("no patch holds enough stars after the cuts", file=sys.stderr)
        return 1
    output = a.output if "://" in a.output else os.path.abspath(a.output)
    write_named_files(run.candidates, run.members, output, stars, TOP)
    write_summary(patch_summary(run.patches, run.star_patch), f"{output if '://' in output else 'file://' + output}/patches")
    n = run.candidates.count()
    say(f"Candidates: {n}")
    for r in report(run.candidates).collect() if n else ():
        say(f"{r['candidate_id']:<4} {r['significance']:<10.2f} {r['n_stars']:<8} {r['mean_ra']:<8.2f} {r['mean_dec']:<8.2f}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
