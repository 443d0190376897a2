import pytest
from comparing import rows
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from rarelabel.functions.features import Features, feature_names, vector_width
from rarelabel.plans.importer import export_vectors, import_text
from rarelabel.sources import libsvm, tables, text
from rarelabel.sources.schemas import TableSchema, declared_schema, declared_schemas

SCHEMA = TableSchema.parse("small", "a kind:s flag:b label")


def write_lines(path, *lines):
    path.mkdir()
    (path / "part-0").write_text("\n".join(lines) + "\n")
    return str(path)


def test_declared_schemas_have_the_expected_widths():
    widths = {n: len(s.names) for n, s in declared_schemas().items()}
    assert widths == {
        "cleveland": 76, "ann": 22, "acs_16": 17, "acs_26": 27, "acs_39_combined": 40,
        "acs_42": 43, "MACCE_d14": 15, "MACCE_d36": 37,
    }
    assert declared_schema("ann").indexed == [f"f{i}" for i in range(2, 17)] + ["label"]
    with pytest.raises(KeyError):
        declared_schema("unknown")


def test_encoded_order_puts_indexed_columns_last():
    names = [n for n in declared_schema("acs_42").encoded_order if n != "label"]
    assert (names[0], names[14], names[15], names[16]) == ("Age", "LVEF", "Hb_Admission", "Crea_Admission")
    assert names[32:] == [
        "Continent", "Country", "Hx_CHF", "CKD", "Ulcus", "Killip2", "Revasc_Complete",
        "Transfusion_IH", "ReAMI_IH", "HF_IH",
    ]


def test_schema_rejects_repeated_names():
    with pytest.raises(ValueError):
        TableSchema.parse("bad", "a b a")


def test_raw_schema_is_all_strings():
    assert [f.dataType.simpleString() for f in SCHEMA.raw] == ["string"] * 4


def test_text_ignores_outer_blanks_and_splits_on_any_whitespace(spark, tmp_path):
    path = write_lines(tmp_path / "t", "  1.5 x  true\t0 ", "", "\t2 y false 1")
    assert rows(text.read_table(spark, path, SCHEMA)) == [(1.5, "x", "true", 0.0), (2.0, "y", "false", 1.0)]


def test_text_rejects_by_reason(spark, tmp_path):
    path = write_lines(tmp_path / "t", "1 x true 0", "1 x true", "1 x true 0 9", "one x true 0", "-9 x true 0")
    found = text.rejected_rows(spark, path, SCHEMA, missing=["-9"])
    assert rows(found, "reason") == [("bad_number",), ("too_few_fields",), ("too_many_fields",)]
    assert text.read_table(spark, path, SCHEMA).filter("a is null").count() == 1


def test_missing_tokens_and_required_columns(spark, tmp_path):
    path = write_lines(tmp_path / "t", "-9 ? true 0", "2 y false 1")
    kept = text.read_table(spark, path, SCHEMA, missing=["-9", "?"])
    assert rows(kept.filter("kind is null"), "a") == [(None,)]
    assert text.read_table(spark, path, SCHEMA, ["-9"], ["a"]).count() == 1


def test_written_text_reads_back(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "a b", "true", 0.0)], "a double, kind string, flag string, label double")
    text.write_table(df, str(tmp_path / "t"), blanks="underscore")
    assert rows(text.read_table(spark, str(tmp_path / "t"), SCHEMA)) == [(1.0, "a_b", "true", 0.0)]


def test_import_encodes_missing_values_as_a_category(spark, tmp_path):
    path = write_lines(tmp_path / "t", "1 x true 0", "2 x false 1", "3 ? true 0", "4 y true 1")
    done = import_text(spark, path, SCHEMA, str(tmp_path / "out"), missing=["?"])
    assert done.table.columns == ["a", "label", "kind", "flag"]
    assert rows(done.table) == [(1.0, 0.0, 0.0, 0.0), (2.0, 1.0, 0.0, 1.0), (3.0, 0.0, 1.0, 0.0), (4.0, 1.0, 2.0, 0.0)]
    assert rows(done.histogram) == [(0.0, 2), (1.0, 2)]
    assert rows(done.vocabulary.values("kind"), "value", "idx") == [("__missing__", 1), ("x", 0), ("y", 2)]


def test_import_replaces_old_output_and_exports_vectors(spark, tmp_path):
    out = str(tmp_path / "out")
    for line in ("1 x true 0", "7 x true 1"):
        path = write_lines(tmp_path / f"t{line[0]}", line)
        table = import_text(spark, path, SCHEMA, out).table
    assert rows(table, "a") == [(7.0,)]
    names = export_vectors(table, str(tmp_path / "v"), exclude=["flag"])
    assert names == ["a", "kind"]
    back = libsvm.read_libsvm(spark, str(tmp_path / "v"), 2)
    assert [(r.label, list(r.features.toArray())) for r in back.collect()] == [(1.0, [7.0, 0.0])]


def test_import_with_non_ascii_names(spark, tmp_path):
    schema = declared_schema("MACCE_d14")
    line = "61 1 0 0 2 0 55 6.1 3.2 2 1 0 1 1 0"
    table = import_text(spark, write_lines(tmp_path / "t", line), schema, str(tmp_path / "o")).table
    assert table.columns == schema.encoded_order
    assert table.first()["年龄"] == 61.0


def test_libsvm_keeps_trailing_zeros(spark, tmp_path):
    df = spark.createDataFrame([(1.0, Vectors.sparse(3, [0], [1.0])), (0.0, Vectors.dense(0, 0, 0))], ["label", "features"])
    libsvm.write_libsvm(libsvm.to_dense(df), str(tmp_path / "v"))
    back = libsvm.read_libsvm(spark, str(tmp_path / "v"), 3)
    assert sorted((r.label, list(r.features.toArray())) for r in back.collect()) == [
        (0.0, [0.0, 0.0, 0.0]),
        (1.0, [1.0, 0.0, 0.0]),
    ]
    assert vector_width(back, "features") == 3


def test_dataset_paths():
    assert tables.dataset_path("data/", "acs_42") == "data/acs_42.libsvmForm"
    assert tables.dataset_path("data", "acs_42", "chisq", 5) == "data/acs_42.Chisq.5.libsvmForm"
    assert tables.dataset_path("data", "ann", "oversampling") == "data/annoversampling.libsvmForm"
    with pytest.raises(ValueError):
        tables.dataset_path("data", "ann", "pca")


def test_profile_counts_nulls_and_values(spark):
    df = spark.createDataFrame([(1, "a"), (3, None), (3, "a")], "x int, s string")
    assert rows(tables.profile(df, "exact"), "column", "nulls", "n_distinct", "min_value", "max_value") == [
        ("s", 1, 1, None, None),
        ("x", 0, 2, 1.0, 3.0),
    ]


def test_row_ids_are_stable_once_stored(spark, tmp_path):
    df = tables.with_row_id(spark.range(100).select((F.col("id") % 3).alias("v")), str(tmp_path / "r"))
    assert df.select("row_id").distinct().count() == 100
    assert rows(df) == rows(df.repartition(5))


def test_first_rows_and_feature_names(spark):
    df = spark.range(10).selectExpr("id", "id * 2 as x", "id % 2 as label")
    assert rows(tables.first_rows(df, ["id"], 2), "id") == [(0,), (1,)]
    assert feature_names(df, "label", ["id"]) == ["x"]
    with pytest.raises(ValueError):
        feature_names(df, "label", ["nope"])


def test_long_form_is_the_same_for_columns_and_vectors(spark):
    from rarelabel.operators.encode import assemble

    df = spark.createDataFrame([(1, 0.0, 2.0), (0, 3.0, 4.0)], "label int, a double, b double")
    wide = Features.columns(["a", "b"]).long(df, ["label"])
    vectors = assemble(df, ["a", "b"])
    packed = Features.of_vector("features", 2).long(vectors, ["label"])
    assert rows(wide) == rows(packed)


def test_spread_only_touches_tables_in_few_pieces(spark):
    cores = spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, cores)
    assert tables.spread(many, ["id"]) is many
    assert tables.spread(spark.range(0, 100, 1, 1), ["id"]).rdd.getNumPartitions() == cores
