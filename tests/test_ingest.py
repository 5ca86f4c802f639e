"""The limited ingest: the stream, restarted half-way and with late rows, against the batch twin and a plain loop."""

import json
import random

from pyspark.sql import functions as F

from tallymark.streaming import ingest

RAW = "seq long, forwarded string, real string, kind string, ts long, path string, ref string, form string, email string"


def log(n=900, seed=2):
    """Requests in order of arrival; some carry times before those already seen."""
    rng = random.Random(seed)
    out, now = [], 1_000_000
    for k in range(n):
        now += rng.randint(0, 400)
        late = rng.randint(1000, 90_000) if rng.random() < 0.1 else 0
        ip = rng.choice(["1.1.1.1", "1.1.1.1", "1.1.1.1", "2.2.2.2, 9.9.9.9", "", None])
        if rng.random() < 0.2:
            out.append((k, ip, rng.choice([" 3.3.3.3 ", None]), "contact", now - late, None, None, rng.choice(["contacto", "sumate", "other", None]), rng.choice(["a@b.co", "no", None])))
        else:
            out.append((k, ip, None, rng.choice(["pageview"] * 9 + ["else"]), now - late, rng.choice(["/a", "/a", " /b ", "x", "", None, "/" + "y" * 600]), rng.choice([None, "r", ""]), None, None))
    return out


def plain(rows):
    """Each request against all that passed before it, in order of arrival."""
    passed, out = [], {}
    for seq, fwd, real, kind, ts, path, _, form, email in sorted(rows):
        if kind not in ingest.LIMITS:
            continue
        key = fwd.split(",")[0].strip() if fwd else (real.strip() if real else "unknown")
        most, span = ingest.LIMITS[kind]
        ts = max([ts, *[t for k, c, t in passed if k == key and c == kind]])
        if sum(k == key and c == kind and t > ts - span for k, c, t in passed) >= most:
            out[seq] = "limited"
            continue
        passed.append((key, kind, ts))
        fine = (path or "")[:500].strip().startswith("/") if kind == "pageview" else form in ingest.FORMS and email == "a@b.co"
        out[seq] = "accepted" if fine else "invalid"
    return out


def test_batch_against_a_loop(spark):
    rows = log()
    got = ingest.verdicts(ingest.requests(spark.createDataFrame(rows, RAW).repartition(5))).collect()
    want = plain(rows)
    assert {r.seq: r.verdict for r in got} == want and len(got) == len(want)
    assert set(want.values()) == {"accepted", "invalid", "limited"}
    assert max(len(r.path or "") for r in got) == 500
    report = {(r.kind, r.verdict): r.n for r in ingest.rejects(spark.createDataFrame(got)).collect()}
    assert sum(report.values()) == sum(v != "accepted" for v in want.values())
    assert ingest.verdicts(ingest.requests(spark.createDataFrame([], RAW))).count() == 0


def test_stream_is_its_batch_twin_across_a_restart(spark, tmp_path):
    rows = log(500, seed=6)
    names = [c.split()[0] for c in RAW.split(", ")]
    (tmp_path / "in").mkdir()

    def arrive(k, part):
        (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps(dict(zip(names, r))) + "\n" for r in part))

    def run():
        stream = ingest.requests(spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")))
        q = ingest.write(stream, str(tmp_path / "out"), str(tmp_path / "check"), idle=None, availableNow=True)
        assert q.awaitTermination(120)

    arrive(0, rows[:170])
    arrive(1, rows[170:260])
    run()
    arrive(2, rows[260:])  # after a restart from the checkpoint
    run()
    got = spark.read.json(str(tmp_path / "out")).select("seq", "verdict").collect()
    want = {r.seq: r.verdict for r in ingest.verdicts(ingest.requests(spark.createDataFrame(rows, RAW))).collect()}
    assert len(got) == len(want) and {r.seq: r.verdict for r in got} == want == plain(rows)
    assert spark.read.json(str(tmp_path / "out" / "verdict=accepted")).where(F.col("path").isNull() & F.col("form").isNull()).count() == 0
