import pytest

from zoneflow.config import (
    SourceConfig,
    expand_path,
    file_name,
    months_between,
    split_month,
)


def test_months():
    assert split_month("2024-01") == ("2024", "01")
    assert months_between("2023-11", "2024-02") == ["2023-11", "2023-12", "2024-01", "2024-02"]
    assert months_between("2024-02", "2024-01") == []
    for wrong in ("2024-13", "2024-1", "202401", "2024-00", "x"):
        with pytest.raises(ValueError, match="YYYY-MM"):
            split_month(wrong)


def test_zone_paths(cfg):
    assert cfg.batch_path("raw", "2024-01") == f"{cfg.root}/raw/yellow-trips/year=2024/month=01"
    assert cfg.zone_root("landing") == f"{cfg.root}/landing/yellow-trips"
    assert cfg.batch_path("structured", "2024-01").endswith("/yellow-trips/batch_month=2024-01")
    assert cfg.table == "yellow_trips"
    other = SourceConfig(
        root="a", source="s", pattern="{root}/x/{source}/{zone}/year={year}/month={month}"
    )
    assert other.zone_root("raw") == "a/x/s/raw"


def test_landing_root():
    cfg = SourceConfig(root="lake/", source="s", landing_root="inbox/")
    assert cfg.batch_path("landing", "2024-01") == "inbox/landing/s/year=2024/month=01"
    assert cfg.zone_root("raw") == "lake/raw/s"


def test_path_patterns():
    pattern = "landing/{source}/year={year}/{filename}"
    name = file_name("yellow_tripdata", "2024-01", "parquet")
    assert name == "yellow_tripdata_2024-01.parquet"
    assert expand_path(pattern, source="a", year="2024", filename=name).endswith(f"2024/{name}")
    with pytest.raises(ValueError, match="filename"):
        expand_path(pattern, source="a", year="2024")


def test_source_config_from_parameters():
    made = SourceConfig.from_mapping({"root": "r", "source": "s", "fmt": "csv"})
    assert made == SourceConfig(root="r", source="s", fmt="csv")
    with pytest.raises(ValueError, match="missing required parameters: root, source"):
        SourceConfig.from_mapping({"fmt": "csv"})
    with pytest.raises(ValueError, match="unknown parameters: bucket"):
        SourceConfig.from_mapping({"root": "r", "source": "s", "bucket": "b"})
    with pytest.raises(ValueError, match="xml"):
        SourceConfig(root="r", source="s", fmt="xml")
    with pytest.raises(ValueError, match="pattern"):
        SourceConfig(root="r", source="s", pattern="{root}/{zone}")
