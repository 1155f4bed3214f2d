import pytest
from marginalia.sources import uploads as U


def test_upload_folder(spark, tmp_path):
    for name in ("a.pdf", "b.pdf", "c.txt"):
        (tmp_path / name).write_text(f"text of {name}")
    found = U.upload_dir(spark, str(tmp_path)).select("filename", "length").orderBy("filename").collect()
    assert [tuple(r) for r in found] == [("a.pdf", 13), ("b.pdf", 13)]
    assert [tuple(r) for r in U.text_documents(spark, str(tmp_path / "c.txt")).collect()] == [("c.txt", "text of c.txt")]


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_files_of_one_number_go_by_name(spark, parts):
    files = [(1, 5, n, True) for n in "eacdb"] + [(1, 6, "0", False), (2, 1, "b", True), (2, 1, "a", False), (3, 1, "b", False), (3, 1, "a", True)]
    batch = U.upload_batch(spark.createDataFrame(files, "batch_id int, file_no int, filename string, ok boolean").repartition(parts))
    assert sorted(map(tuple, batch.collect())) == [*((1, n, i) for i, n in enumerate("abcde")), (3, "a", 0)]


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    for _ in range(2):
        U.write_tables({"t": df}, str(tmp_path))
    assert sorted(spark.read.parquet(str(tmp_path / "t")).collect()) == sorted(df.collect())


def test_database_table_in_ranges(spark):
    url = "jdbc:derby:memory:sources;create=true"
    own = spark.createDataFrame([(i, f"name {i}") for i in range(40)], "id long, name string")
    own.write.jdbc(url, "users", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    found = U.read_jdbc(spark, url, "users", "id", (0, 40), 4, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert found.rdd.getNumPartitions() == 4
    assert sorted(tuple(r) for r in found.collect()) == [(i, f"name {i}") for i in range(40)]
