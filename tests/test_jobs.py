"""Jobs that meet broken kernels and sinks, what they report, and the surfaces around them."""

from __future__ import annotations

import json
import math
import os
import time

import pytest
from test_engine import client, numbers, values  # noqa: F401

from rowloom.config import Config
from rowloom.operators.kernels import REGISTRY, register_op
from rowloom.plans.lower import Performance
from rowloom.sources.catalog import ExternalSink, FrameStream
from rowloom.sources.files import ElementSink


@register_op(name="Plus", replace=True)
def plus(config, x: float) -> float:
    return x + 1


@register_op(name="Hangs", replace=True)
def hangs(config, x: int) -> int:
    if x == config.args["bad"]:
        time.sleep(60)
    return x


@register_op(name="Dies", replace=True)
def dies(config, x: int) -> int:
    if x == config.args["bad"]:
        os._exit(3)
    return x


class Lines(ElementSink):
    def new_stream(self, options):
        self.file, self.seen = open(f"{options['folder']}/{os.urandom(4).hex()}.part", "w"), 0

    def write(self, row_id, value):
        self.seen += 1
        self.file.write(f"{row_id} {value}\n")

    def close(self):
        self.file.close()
        return self.seen

    def finished(self, options, results):
        with open(f"{options['folder']}/done", "w") as f:
            f.write(str(sum(results)))


def test_nan_is_a_value_and_null_is_none(spark, client):  # noqa: F811
    df = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, None)], "id long, x double")
    got = values(client.frame(client.ops.Plus(x=client.io.Input([FrameStream(df, "id", "x")]))))
    assert got[0] == 2.0 and math.isnan(got[1]) and got[2] is None


def test_a_task_that_hangs_fails_its_stream_alone(spark, client):  # noqa: F811
    x = client.io.Input([numbers(spark, 4), numbers(spark, 30)])
    outs = [client.stream("quick"), client.stream("stuck")]
    start = time.time()
    job = client.run(client.io.Output(client.ops.Hangs(x=x, bad=20), outs), task_timeout=2.0)
    assert [s.committed() for s in outs] == [True, False] and "2.0 s" in client.job_status(job)["failed"]["stuck"] and time.time() - start < 50


def test_a_kernel_that_ends_its_worker_fails_its_stream_alone(spark, client):  # noqa: F811
    x = client.io.Input([numbers(spark, 3), numbers(spark, 9), numbers(spark, 4)])
    outs = [client.stream(f"d{i}") for i in range(3)]
    job = client.run(client.io.Output(client.ops.Dies(x=x, bad=8), outs))
    assert [s.committed() for s in outs] == [True, False, True] and list(client.job_status(job)["failed"]) == ["d1"]
    assert list(outs[2].load()) == [0, 1, 2, 3]


def test_external_sinks_report_failed_streams(spark, client, tmp_path):  # noqa: F811
    x = client.io.Input([numbers(spark, 3), numbers(spark, 9)])
    sinks = [ExternalSink(f"x{i}", "json", str(tmp_path / f"x{i}")) for i in range(2)]
    job = client.run(client.io.Output(client.ops.Poison(x=x, bad=7), sinks))
    assert "bad value" in client.job_status(job)["failed"]["x1"] and not (tmp_path / "x1").exists()
    assert sorted(r["row_id"] for r in spark.read.json(str(tmp_path / "x0")).collect()) == [0, 1, 2]


def test_sinks_in_python(spark, client, tmp_path):  # noqa: F811
    from pyspark.cloudpickle import register_pickle_by_value
    import sys

    register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(Lines)
    sink = ExternalSink("lines", "lines", mode="append", folder=str(tmp_path))
    client.run(client.io.Output(client.ops.Doubled(x=client.io.Input([numbers(spark, 5)])), [sink]))
    assert (tmp_path / "done").read_text() == "5"
    assert sorted(line for p in tmp_path.glob("*.part") for line in p.read_text().split("\n") if line) == ["0 0", "1 2", "2 4", "3 6", "4 8"]


def test_tables_profiles_and_enumerators(spark, client, tmp_path):  # noqa: F811
    made = client.catalog.new_table("two", ["a", "b"], [[b"x", b"1"], [None, b"2"]])
    table = client.table("two")
    assert table.columns() == ["a", "b"] and table.num_rows() == 2 and table.parent_rows() == [0, 1]
    assert [tuple(map(str, r)) for r in table.load()] == [("b'x'", "b'1'"), ("NullElement()", "b'2'")]
    assert list(table.load(["b"], rows=[1], decode=lambda v: v.decode())) == ["2"]
    assert made.enumerator().total_elements() == 2 and made.enumerator().element_args_at(1) == {"row_id": 1}
    with pytest.raises(IndexError):
        made.enumerator().element_args_at(2)
    job = client.run(client.io.Output(client.ops.Doubled(x=client.io.Input([numbers(spark, 50)])), [client.stream("timed")]))
    profile = client.get_profile(job)
    assert profile.tasks and all(end >= start for _, _, start, end in profile.tasks)
    profile.write_trace(str(tmp_path / "trace.json"))
    assert any(str(e["pid"]).startswith("executor") for e in json.loads((tmp_path / "trace.json").read_text())["traceEvents"])


def test_loaded_operations(spark, client, tmp_path):  # noqa: F811
    path = tmp_path / "more_ops.py"
    path.write_text("from rowloom.operators.kernels import register_op\n\nSHIFT = 5\n\n\n@register_op(name='Shifted', replace=True)\ndef shifted(config, x: int) -> int:\n    return x + SHIFT\n")
    client.load_op(str(path))
    assert "Shifted" in REGISTRY and values(client.frame(client.ops.Shifted(x=client.io.Input([numbers(spark, 3)])))) == [5, 6, 7]


def test_settings(spark, tmp_path):
    path = tmp_path / "settings.toml"
    path.write_text("[spark]\nspark.sql.shuffle.partitions = 9\nspark.ui.enabled = false\n[storage]\nwarehouse = '/w'\n[performance]\nbatch_rows = 7\n")
    read = Config.read(str(path))
    assert read.spark == {"spark.sql.shuffle.partitions": "9", "spark.ui.enabled": "false"} and read.warehouse == "/w" and read.performance.batch_rows == 7
    for tables in ({"more": {}}, {"storage": {"x": 1}}, {"performance": {"x": 1}}):
        with pytest.raises(ValueError):
            Config.of(tables)
    assert Config.of({"storage": {"warehouse": str(tmp_path / "w")}}).client(spark).catalog.names() == []


def test_packet_sizes_change_no_result(spark, client):  # noqa: F811
    x = client.io.Input([numbers(spark, 40)])
    manual, estimated = Performance.manual(5, 10), Performance.estimate(element_bytes=1 << 20)
    assert (manual.batch_rows, manual.chunk_rows) == (5, 10) and estimated.batch_rows == 16
    whole = values(client.frame(client.ops.Window(x=x)))
    assert values(client.frame(client.ops.Window(x=x), performance=manual)) == values(client.frame(client.ops.Window(x=x), performance=estimated)) == whole
