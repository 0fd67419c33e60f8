"""Lines with stable numbers in batch and streams; the readers of orders, forwards, stamps."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tickspark.operators import resample
from tickspark.sources import lines, ticks
from tickspark.streaming import stream


def written(folder, seed=1, files=3):
    """Files of lines of various lengths, some empty, some ended by two characters, some files without a last line end."""
    rng, out = random.Random(seed), {}
    folder.mkdir(parents=True)
    for i in range(files):
        body = b"".join(("é" * rng.choice([0, 1, 5, 300]) + str(rng.randrange(99))).encode()[: rng.randrange(0, 400)].decode(errors="ignore").encode() + rng.choice([b"\n", b"\r\n"]) for _ in range(rng.randrange(0, 60)))
        body += b"last" if i % 2 else b""
        (folder / f"{i}.tsv").write_bytes(body)
        out[i] = body
    (folder / "_SUCCESS").write_text("not a file of lines")
    return out


def numbered(bodies):
    """(seq, line) of files in order."""
    out = []
    for i, body in enumerate(bodies):
        at = 0
        for line in body.split(b"\n")[: None if body and not body.endswith(b"\n") else -1]:
            out.append((i << 40 | at, line.removesuffix(b"\r").decode()))
            at += len(line) + 1
    return out


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_ranges_have_each_line_once(tmp_path, block):
    bodies = written(tmp_path / "a")
    for i, body in bodies.items():
        path = str(tmp_path / "a" / f"{i}.tsv")
        for size in (1, 13, 100, 10**6):
            got = []
            for start in range(0, len(body), size):
                for at, found in lines.lines_in(path, start, min(len(body), start + size), block):
                    for line in found:
                        if at < min(len(body), start + size):
                            got.append((at, line.removesuffix(b"\r").decode()))
                        at += len(line) + 1
            assert got == numbered([body])


def test_numbers_are_the_same_at_each_size_of_a_split(spark, tmp_path):
    bodies = written(tmp_path / "a", files=4)
    want = numbered(bodies.values())
    first, second = str(tmp_path / "a"), [str(tmp_path / "a" / f"{i}.tsv") for i in range(4)]
    for paths, split in (([first], 50), ([first], 1 << 20), (second, 333), ([f"file://{first}"], 64)):
        read = ticks.read_lines(spark, *paths, split=split)
        assert sorted((r.seq, "\t".join(r.f)) for r in read.collect()) == want
    assert ticks.read_lines(spark, first, split=50).rdd.getNumPartitions() > 4
    reverse = ticks.read_lines(spark, *second[::-1])
    assert sorted((r.seq, "\t".join(r.f)) for r in reverse.collect()) == numbered(list(bodies.values())[::-1])
    assert "1.tsv" in {r.path.rsplit("/")[-1] for r in reverse.collect()}
    with pytest.raises(Exception, match="nowhere"):
        ticks.read_lines(spark, str(tmp_path / "nowhere")).collect()


def test_ties_of_time_settle_by_line(spark, tmp_path):
    """Of rows of one stamp the last line of the last file counts, at each size of a split."""
    (tmp_path / "q").mkdir()
    for i in range(3):
        (tmp_path / "q" / f"{i}.tsv").write_text("".join(f"5.000000000\tX\t{100 * i + k}\t{100 * i + k + 1}\n" for k in range(40)))
    for split in (32, 1 << 20):
        got = resample.align(ticks.quotes_of(ticks.read_lines(spark, str(tmp_path / "q"), split=split)), "10s").first()
        assert (got.bid, got.ask) == (239, 240)


def test_a_stream_of_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    stamp = lambda t: f"{t}.000000000"

    def more(i):
        (folder / f"{i}.tsv").write_text("".join(f"{stamp(1000 + 100 * i + k)}\tX\t{i}\t{k + 1}\n" for k in range(90)))

    def run():
        read = ticks.stream_quotes(spark, str(folder), split=400, settle=0).drop("path")
        for name, made in (("rows", read), ("aligned", stream.align(read, "10s", late="1 second"))):
            made.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}_c")).option("path", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return [sorted((r.t // 10**9, r.seq >> 40, int(r.bid)) for r in spark.read.parquet(str(tmp_path / name)).collect()) for name in ("rows", "aligned")]

    for i in range(3):
        more(i)
        rows, aligned = run()
        assert rows == [(1000 + 100 * n + k, n, n) for n in range(i + 1) for k in range(90)]
    # a bucket comes out once the watermark has passed it: those of the first file by the third run at the latest
    assert aligned[:9] == [(t, 0, 0) for t in range(1000, 1081, 10)]


def test_orders_and_forwards(spark, tmp_path):
    (tmp_path / "o").write_text("5.000\tLONG\tX\t1.5\t2\t1\n6.000\tSHORT\tX\tMKT\n7.000\tNOTE\tX\nx\tLONG\tX\n8.000\tE\n")
    rows = [tuple(r) for r in ticks.read_orders(spark, str(tmp_path / "o")).orderBy("t").select("t", "side", "instr", "limit_px", "target_px", "stop_px").collect()]
    assert rows == [(5 * 10**9, "LONG", "X", Decimal("1.5"), 2, 1), (6 * 10**9, "SHORT", "X", None, None, None), (8 * 10**9, "CANCEL", None, None, None, None)]
    (tmp_path / "f").write_text("5.000\tF1\tX\t0.1\t0.2\n6.000\tF2\tY\t\t0.3\n")
    rows = [tuple(r) for r in ticks.read_forwards(spark, str(tmp_path / "f")).orderBy("seq").select("t", "fwd_id", "underlying", "bid", "ask").collect()]
    assert rows == [(5 * 10**9, "F1", "X", Decimal("0.1"), Decimal("0.2")), (6 * 10**9, "F2", "Y", None, Decimal("0.3"))]
    both = ticks.any_lines(spark, str(tmp_path / "o")).select(F.size("f").alias("n")).collect()
    assert sorted(r.n for r in both) == [2, 3, 3, 4, 6]
