"""One JSON object read by many tasks gives what one task reads."""

from __future__ import annotations

import json
import random

import pytest

from omixel.sources import files


@pytest.fixture(scope="module")
def catalogue():
    rng = random.Random(9)
    odd = ['a "quoted" name', "brace } in { it", 'back\\slash\\', 'ends in \\"', "}{", '"', "naïve é 漢 \U0001f600", "", "line\nbreak", '\\"}', "\\\\"]
    return {f"set {i} {rng.choice(odd)}": {"name": rng.choice(odd), "source": rng.choice(("GO", "WP}")), "genes": [f"G{rng.randrange(90)}" + rng.choice(("", "}", '"')) for _ in range(rng.randrange(0, 12))], "n_genes": i} for i in range(400)}


def _told(pair):
    sets, membership = pair
    return sorted(map(str, sets.collect())), sorted(map(str, membership.collect()))


@pytest.mark.parametrize(("indent", "split"), [(None, 1 << 27), (None, 3000), (1, 3000)])
def test_equal(spark, catalogue, tmp_path, indent, split):
    path = f"{tmp_path}/sets.json"
    with open(path, "w") as f:
        json.dump(catalogue, f, indent=indent, ensure_ascii=split == 3000)
    want = _told(files.read_sets(spark, path))
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    try:
        for k in keys:
            spark.conf.set(k, str(split))
        tasks = spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions()
        got = _told(files.read_large_sets(spark, path))
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)
    assert got == want and len(want[0]) == 400 and (tasks > 10 or split > 3000)


def test_lines_and_nothing(spark, catalogue, tmp_path):
    """Several objects, one a line, and files without an entry."""
    items = list(catalogue.items())
    with open(f"{tmp_path}/lines.json", "w") as f:
        f.writelines(json.dumps(dict(items[i : i + 7])) + "\n" for i in range(0, 70, 7))
    assert len(_told(files.read_large_sets(spark, f"{tmp_path}/lines.json"))[0]) == 70
    for text in ("{}", "", " \n"):
        with open(f"{tmp_path}/none.json", "w") as f:
            f.write(text)
        assert _told(files.read_large_sets(spark, f"{tmp_path}/none.json")) == ([], [])
