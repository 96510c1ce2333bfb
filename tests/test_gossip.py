"""Verdicts on gossiped checkpoints against a plain loop over the same batches."""

import os
import random
import shutil
from datetime import datetime, timezone

from sealstone.streaming import gossip

SCHEMA = "signer long, scope string, shard_id string, size long, previous string, root string, ts timestamp_ltz, arrival long"
LIVE, LATE = 3_600_000, 600_000


def plain(batches):
    held, mark, out = {}, 0, []
    for rows in batches:
        for x in sorted(rows, key=lambda x: x[7]):
            key, seen = x[:3], x[6]
            if seen < mark:
                out.append((x[7], "late"))
                continue
            own = held.get(key)
            if own and (own[2] <= mark or own[2] <= seen):
                own = None
            verdict = "stale" if own and x[3] <= own[0] else "spliced" if own and x[3] == own[0] + 1 and x[4] != own[1] else "accepted"
            if verdict == "accepted":
                held[key] = (x[3], x[5], seen + LIVE)
            out.append((x[7], verdict))
        mark = max(mark, max(x[6] for x in rows) - LATE)
        held = {k: v for k, v in held.items() if v[2] > mark}
    return sorted(out)


def batches(seed, n=5):
    r, at, out, arrival = random.Random(seed), 1_700_000_000_000, [], 0
    for _ in range(n):
        rows = []
        for _ in range(60):
            size = r.randrange(1, 9)
            seen = at + r.randrange(-1_500_000, 1_200_000)
            rows.append((r.randrange(2), r.choice(("a", "b")), r.choice(("x", "y")), size, f"r{size - r.choice((1, 1, 2))}", f"r{size}", seen, arrival))
            arrival += 1
        out.append(rows)
        at += r.choice((600_000, 1_800_000, 5_000_000))
    return out


def test_verdicts_over_several_files(spark, tmp_path):
    all_ = batches(4)
    at = tmp_path / "in"
    for i, rows in enumerate(all_):
        frame = spark.createDataFrame([(*x[:6], datetime.fromtimestamp(x[6] / 1000, timezone.utc), x[7]) for x in rows], SCHEMA)
        frame.coalesce(1).write.parquet(str(at / str(i)))
    identity = ["signer", "scope", "shard_id"]

    def run(upto, out):
        """All files so far, one a batch, by a stream that goes on from its checkpoint."""
        flat = tmp_path / f"{out}-files"
        flat.mkdir(exist_ok=True)
        for i in range(upto):
            if not (to := flat / f"{i}.parquet").exists():
                shutil.copy(next((at / str(i)).glob("part-*.parquet")), to)
                os.utime(to, (1_700_000_000 + i, 1_700_000_000 + i))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(flat))
        done = gossip.stored(gossip.judged(stream, identity, live=LIVE, late="10 minutes"), str(tmp_path / out / "out"), str(tmp_path / out / "checkpoint"))
        return sorted((x.arrival, x.verdict) for x in done.collect())

    want = plain(all_)
    assert {v for _, v in want} == {"late", "stale", "spliced", "accepted"}
    assert run(len(all_), "one") == want
    assert run(3, "two") == plain(all_[:3])  # stopped, and begun again where it was
    assert run(len(all_), "two") == want
    assert spark.conf.get(gossip.PROVIDER[0], None) != gossip.PROVIDER[1]


def test_a_nonce_may_come_again_after_its_time(spark, tmp_path):
    from sealstone.streaming import operators

    start = 1_700_000_000
    batches_ = [[("a", 0), ("a", 5), ("b", 10)], [("b", 60), ("c", 3600)], [("d", 3700)], [("a", 3700), ("c", 3650), ("late", 5)], [("a", 3800)]]
    flat = tmp_path / "in"
    flat.mkdir()
    for i, rows in enumerate(batches_):
        spark.createDataFrame([(n, datetime.fromtimestamp(start + t, timezone.utc)) for n, t in rows], "nonce string, ts timestamp_ltz").coalesce(1).write.parquet(str(tmp_path / str(i)))
        to = flat / f"{i}.parquet"
        shutil.copy(next((tmp_path / str(i)).glob("part-*.parquet")), to)
        os.utime(to, (start + i, start + i))
    stream = spark.readStream.schema("nonce string, ts timestamp_ltz").option("maxFilesPerTrigger", 1).parquet(str(flat))
    out = operators.stored(operators.first_uses(stream, "ts", "nonce", "10 minutes"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = sorted((x.nonce, int(x.ts.timestamp()) - start) for x in out.collect())
    # Within its time a nonce comes once; an hour later ``a`` may come again, once; what is behind the mark is dropped.
    assert [n for n, _ in got] == ["a", "a", "b", "c", "d"] and got[0][1] in (0, 5) and got[1][1] == 3700
