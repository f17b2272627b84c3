"""The jobs over growing copies of the tables, repeated, broken off, and from the command line."""

import json
import os
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobs import common, note_outliers, survey_ingest
from skyloom.config import DetectConfig
from skyloom.operators import patches, windows
from skyloom.sources.demo import stars_of_events

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
CFG = DetectConfig()


def files(folder):
    return sorted((str(p), p.stat().st_mtime_ns) for p in Path(folder).rglob("*.parquet"))


def deliver(spark, folder, part, of=4):
    """One of ``of`` files of the events table, into a folder that grows."""
    rows = spark.read.parquet(f"{SF}/events.parquet").where(F.pmod("event_id", F.lit(of)) == part)
    rows.coalesce(1).write.mode("append").parquet(str(folder))


def expected(spark, events):
    near = patches.assign_patches(stars_of_events(events), patches.patches_frame(spark, patches.patch_grid(CFG)), CFG.patch_radius)
    stars = sorted((r["patch_id"], r["star_id"]) for r in near.select("patch_id", "star_id").collect())
    good = windows.gate_srs(windows.sr_counts(patches.gate_patches(near, CFG.min_stars_patch), CFG), CFG)
    return stars, sorted(tuple(r) for r in good.select("patch_id", "axis", "i", "n_sr", "n_sb").collect())


def standing(spark, out):
    stars, regions = survey_ingest.read_output(spark, out)
    return sorted((r["patch_id"], r["star_id"]) for r in stars.collect()), sorted(tuple(r) for r in regions.select("patch_id", "axis", "i", "n_sr", "n_sb").collect())


def test_survey_grows_and_is_taken_once(spark, tmp_path):
    source, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    for part in (0, 1):
        deliver(spark, source, part)
    events = spark.read.parquet(f"{SF}/events.parquet")
    first = survey_ingest.run(spark, source, out, marks)
    assert standing(spark, out) == expected(spark, events.where("event_id % 4 < 2"))
    for part in (2, 3):
        deliver(spark, source, part)
    second = survey_ingest.run(spark, source, out, marks, {"files_per_batch": 1})
    assert standing(spark, out) == expected(spark, events)
    assert first["stars"] == second["stars"] == events.count() // 2  # only what was new
    before = files(out)
    assert survey_ingest.run(spark, source, out, marks) == {"stars": 0, "regions": 0}
    assert files(out) == before


def test_survey_run_that_broke_off(spark, tmp_path, monkeypatch):
    source, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    deliver(spark, source, 0, 2)
    good = survey_ingest.windows.gate_srs

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(survey_ingest.windows, "gate_srs", broken)
    with pytest.raises(Exception, match="lost"):
        survey_ingest.run(spark, source, out, marks)
    monkeypatch.setattr(survey_ingest.windows, "gate_srs", good)
    deliver(spark, source, 1, 2)
    survey_ingest.run(spark, source, out, marks)
    assert standing(spark, out) == expected(spark, spark.read.parquet(f"{SF}/events.parquet"))


def test_survey_with_headers_and_cuts(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    stars = stars_of_events(spark.read.parquet(f"{SF}/events.parquet"))
    stars.withColumnsRenamed({"ra": "TARGET_RA", "dec": "Target_Dec", "star_id": "TargetID"}).write.parquet(source)
    settings = {"stars": "catalogue", "dec_min": 49.0, "dec_max": 51.0, "min_stars_patch": 1, "min_stars_sr": 1}
    survey_ingest.run(spark, source, out, str(tmp_path / "marks"), settings)
    found, regions = survey_ingest.read_output(spark, out)
    held = stars.where("dec between 49 and 51")
    near = patches.assign_patches(held, patches.patches_frame(spark, patches.patch_grid(CFG)), CFG.patch_radius)
    assert sorted(map(tuple, found.select("star_id", "patch_id").collect())) == sorted(map(tuple, near.select("star_id", "patch_id").collect()))
    assert regions.agg(F.min("n_sr")).first()[0] == 1
    with pytest.raises(ValueError, match="events or catalogue"):
        survey_ingest.run(spark, source, str(tmp_path / "x"), str(tmp_path / "y"), {"stars": "other"})


def brute(rows, k=5):
    """Scores of one language's records, from the features."""
    x = np.array([[r[c] for c in note_outliers.FEATURES] for r in rows])
    n = len(x)
    order = np.sort(x, axis=0)
    wide = order[3 * n // 4] - order[n // 4]
    z = ((x - order[n // 2]) / np.where(wide > 0, wide, 1)).astype(np.float32)
    d = ((z[:, None] - z[None]) ** 2).sum(axis=2)
    r = np.sqrt(np.sort(d, axis=1)[:, min(k, n - 1)].astype(np.float64))
    return (r.mean() - r) / r.std() if r.std() > 1e-9 and n >= 20 else np.zeros(n)


def test_notes_by_language_and_again(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    n = note_outliers.run(spark, f"{SF}/documents.parquet", whole)
    assert n == {"read": docs.count(), "written": docs.select("doc_id").distinct().count()}
    records, summary = note_outliers.read_output(spark, whole)
    rows, totals = sorted(map(tuple, records.collect())), sorted(map(tuple, summary.collect()))
    for lang in {r["lang"] for r in records.collect()}:
        own = sorted(records.where(F.col("lang") == lang).collect(), key=lambda r: r["doc_id"])
        assert np.allclose([r["score"] for r in own], brute(own), atol=1e-4)
    assert sum(t["records"] for t in summary.collect()) == len(rows)
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    note_outliers.run(spark, f"{SF}/documents.parquet", whole)  # the same again
    assert sorted(map(tuple, note_outliers.read_output(spark, whole)[0].collect())) == rows
    for lang in ("en", None):  # deliveries of languages: each leaves the others
        part = str(tmp_path / f"docs-{lang}")
        docs.where(F.col("lang") == "en" if lang else F.col("lang") != "en").write.parquet(part)
        note_outliers.run(spark, part, parts)
    again = note_outliers.read_output(spark, parts)
    assert sorted(map(tuple, again[0].collect())) == rows and sorted(map(tuple, again[1].collect())) == totals
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == mode


def test_notes_with_gaps(spark, tmp_path):
    rows = [(i, "word " * (3 + i % 4), "en", "log") for i in range(40)] + [(100, "x\n" * 900, "en", "log"), (101, None, None, None), (101, "", "en", "a"), (None, "lost", "en", "a"), (7, "", "en", "log")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "in"))
    assert note_outliers.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), {"flag_below": -2.0}) == {"read": 45, "written": 42}
    records, summary = note_outliers.read_output(spark, str(tmp_path / "out"))
    found = {r["doc_id"]: r for r in records.collect()}
    assert found[100]["flagged"] and found[100]["lines"] == 1000 and not found[1]["flagged"]
    assert (found[101]["lang"], found[101]["source"]) == ("en", "a") and found[7]["words"] > 0
    assert {(r["lang"], r["source"]): (r["records"], r["flagged"]) for r in summary.collect()}["en", "log"][1] >= 1
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "none"))
    assert note_outliers.run(spark, str(tmp_path / "none"), str(tmp_path / "out")) == {"read": 0, "written": 0}
    assert note_outliers.read_output(spark, str(tmp_path / "out"))[0].count() == 42


def test_settings(tmp_path):
    for job in (survey_ingest, note_outliers):
        shown = json.loads((ROOT / "jobs" / f"{job.__name__.split('.')[1]}.json").read_text())
        assert shown == job.DEFAULTS and all(isinstance(v, type(job.DEFAULTS[c])) for c, v in shown.items())
    (tmp_path / "c.json").write_text('{"neighbors": 3}')
    with pytest.raises(ValueError, match="neighbors"):
        common.settings(note_outliers.DEFAULTS, str(tmp_path / "c.json"))


def test_command_line(tmp_path):
    """Both jobs as a user starts them; the logs say what was read and written."""
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    start = [sys.executable, "-m"]
    (tmp_path / "c.json").write_text(json.dumps({"neighbours": 3, "least_group": 5}))
    notes = subprocess.run([*start, "jobs.note_outliers", "--source", f"{SF}/documents.parquet", "--output", str(tmp_path / "notes"), "--config", str(tmp_path / "c.json")], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert notes.returncode == 0, notes.stderr[-2000:]
    assert "read 200 rows" in notes.stderr and "wrote 200 records" in notes.stderr
    arguments = ["--source", f"{SF}/events.parquet", "--output", str(tmp_path / "sky"), "--checkpoint", str(tmp_path / "marks")]
    for taken in (1000, 0):
        sky = subprocess.run([*start, "jobs.survey_ingest", *arguments], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
        assert sky.returncode == 0, sky.stderr[-2000:]
        assert f"took {taken} new rows" in sky.stderr
    assert files(tmp_path / "sky") and files(tmp_path / "notes")


def test_texts_are_read_once(spark, tmp_path, monkeypatch):
    """A run makes each record's features once, however many steps read them."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        made.add(1)
        return x

    features = note_outliers.features
    monkeypatch.setattr(note_outliers, "features", lambda documents: features(documents).withColumn("words", seen("words")))
    note_outliers.run(spark, f"{SF}/documents.parquet", str(tmp_path / "out"))
    assert made.value == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_words_at_the_ends_of_texts(spark):
    """Words are counted as matches of what is no blank, with blanks of ASCII only and none lost at either end."""
    texts = ["", " ", " \t\n", "a", " a", "a ", " a ", "a b", "\x0ba\x0c\x0db \n c\n", "a\xa0b", " ", "a\x1fb", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    got = {r["doc_id"]: r["words"] for r in note_outliers.features(rows).collect()}
    assert [got[i] for i in range(len(texts))] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
