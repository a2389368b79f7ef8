"""The bars are written once for a state of the input files."""
import os

import pytest

from pricelab.plans.catalog import Ctx
from pricelab.sources import tables as T

from .conftest import SF001


@pytest.fixture()
def folder(spark, tmp_path):
    for name in ("lineitem", "part"):
        T.table(spark, SF001, name).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_bars_are_written_once_and_anew_when_a_file_changes(spark, folder):
    first, second = Ctx(spark, folder).bars(), Ctx(spark, folder).bars()
    assert set(first.inputFiles()) == set(second.inputFiles())
    assert sorted(first.collect()) == sorted(T.bars(spark, folder).collect())
    half = T.table(spark, SF001, "lineitem").where("l_orderkey % 2 = 0")
    half.coalesce(1).write.mode("overwrite").parquet(f"{folder}/lineitem.parquet")
    third = Ctx(spark, folder).bars()
    assert not set(third.inputFiles()) & set(first.inputFiles())
    assert sorted(third.collect()) == sorted(T.bars(spark, folder).collect())


def test_a_file_replaced_in_place_is_a_change(spark, folder):
    before = T.files_state(spark, folder, "lineitem", "part")
    assert before == T.files_state(spark, folder, "lineitem", "part")
    data = next(os.path.join(f"{folder}/part.parquet", f) for f in os.listdir(f"{folder}/part.parquet") if f.endswith(".parquet"))
    os.utime(data, (1, 1))
    assert before != T.files_state(spark, folder, "lineitem", "part")
