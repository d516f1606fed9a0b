import pytest
from helpers import A, build

from gridloom import api
from gridloom.errors import DirectExecutionNotAvailableError


def test_csr_rows_as_delivered(spark):
    rows = spark.createDataFrame([(0, [2, None, 1], [2.0, 9.0, 1.0]), (1, [0], None), (2, None, None), (None, [1], [1.0]), (3, [], []), (4, [1, 1], [5.0])], "i bigint, cols array<bigint>, vals array<double>")
    m = api.matrix_from_csr(rows, 3)
    assert m.dimensions == (5, 3)
    assert sorted(map(repr, map(tuple, m.nz.collect()))) == sorted(map(repr, [(0, 2, 2.0), (0, 1, 1.0), (1, 0, None), (4, 1, 5.0), (4, 1, None)]))


def test_csr_rows_with_only_row_0_or_none(spark):
    rows = spark.createDataFrame([(0, [1], [2.0])], "i bigint, cols array<bigint>, vals array<double>")
    assert api.matrix_from_csr(rows, 3).dimensions == (1, 3) and api.matrix_from_csr(rows.where("i > 0"), 3).dimensions == (0, 3)


def test_layouts_and_graphs(spark, tmp_path):
    m = build(spark, A, 3)
    assert api.as_layout(m, "csr").count() == 3 and api.as_layout(m, "coo") is m
    with pytest.raises(DirectExecutionNotAvailableError):
        api.as_layout(m, "csc", convert_input=False)
    (tmp_path / "e").write_text("0 1\n0 1\n2 1\n")
    g = api.graph_from_edge_list(spark, str(tmp_path / "e"))
    assert g.n == 3 and g.m() == 6
    api.write_mtx(m, str(tmp_path / "m"))
    assert api.graph_from_mtx(spark, str(tmp_path / "m")).m() == 4
    assert api.read_mtx_csr(spark, str(tmp_path / "m")).count() == 3


def test_log_levels_and_sinks(tmp_path):
    from gridloom import experiment
    from gridloom.errors import FunctionNotFoundError

    at = tmp_path / "log"
    experiment.set_log("info", to_console=False, file=str(at))
    experiment.log.info("kept")
    experiment.log.debug("left out")
    experiment.set_log("off")
    experiment.log.error("left out")
    assert at.read_text().endswith("INFO kept\n") and "left out" not in at.read_text()
    with pytest.raises(FunctionNotFoundError):
        experiment.set_log("loud")
    experiment.log.propagate = True
