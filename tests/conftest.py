import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def benchmark_tree(tmp_path):
    """Three images in two batches with their transcripts and the benchmark CSV."""
    texts = {
        ("batch-1", "img_001"): "བཀྲ་ཤིས་བདེ་ལེགས",
        ("batch-1", "img_002"): "ཨོཾ་མ་ཎི་པདྨེ་ཧཱུྃ",
        ("batch-2", "img_003"): "སྤྱན་རས་གཟིགས",
    }
    lines = ["image_name,batch_id,transcript"]
    for i, ((batch, stem), text) in enumerate(texts.items(), 1):
        for tree in ("images", "transcripts"):
            (tmp_path / tree / batch).mkdir(parents=True, exist_ok=True)
        (tmp_path / "images" / batch / f"{stem}.png").write_text(f"fake-image-data-{i}")
        (tmp_path / "transcripts" / batch / f"{stem}.txt").write_text(text, encoding="utf-8")
        lines.append(f"{stem}.png,{batch},{text}")
    (tmp_path / "benchmark.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    return tmp_path
