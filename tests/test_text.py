import pytest
from pyspark.sql import functions as F

from unitweave.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "raw, clean",
    [("(Dept. of X ,Univ Y )", "Dept. of X, Univ Y"), ("a\t b\n", "a b"), (None, ""), ("", ""), ("x( y )z", "x (y) z"), ("3.5", "3. 5")],
)
def test_clean_affiliation(spark, raw, clean):
    assert one(spark, raw, T.clean_affiliation) == clean


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("The Department of Physics (Room 3)", "department of physics"),
        ("Campus Lab", "c us lab"),
        ("Quantum Optics", ""),
        ("3 School of Art", "school of art"),
        (None, ""),
        ("Lab (x\nunit y", "lab x unit y"),
        ("of the School, and", "school"),
        ("École: Unité α", "école unité α"),
    ],
)
def test_clean_department(spark, raw, clean):
    assert one(spark, raw, T.clean_department) == clean


def test_long_runs_of_stop_words(spark):
    outer, inner = "of the and " * 40_000, " of the lab of the" * 20_000
    assert one(spark, f"{outer}school{inner} {outer}", T.clean_department) == f"school{inner}".removesuffix(" of the")
    assert one(spark, outer, T.clean_department) == "" and one(spark, "at office of", T.clean_department) == "office"


def test_amp_can_stay(spark):
    assert one(spark, "Campus Lab", lambda c: T.clean_department(c, blank_amp=False)) == "campus lab"


@pytest.mark.parametrize("raw, core", [("Department of Physics", "physics"), ("Physics Department", "physics"), ("École d'Été & Co.", "ecole d ete co"), (None, ""), ("School", "school")])
def test_core_name(spark, raw, core):
    assert one(spark, raw, lambda c: T.core_name(T.fold_name(c))) == core


@pytest.mark.parametrize(
    "raw, parts",
    [
        ("jane doe school of art", ("jane doe", "school of art", True)),
        ("school of art", ("", "school of art", False)),
        ("art school", ("", "", False)),
        ("a b c d school of art", ("a b c d", "school of art", False)),
        ("jane 2 school of art", ("jane 2", "school of art", False)),
        ("", ("", "", False)),
        (None, ("", "", False)),
    ],
)
def test_split_prefix(spark, raw, parts):
    assert tuple(one(spark, raw, T.split_prefix)) == parts


def test_abbreviations_are_whole_words(spark):
    assert one(spark, "dept of art", T.is_abbreviation) and not one(spark, "laboratory", T.is_abbreviation)


def test_ids_and_slices(spark):
    assert one(spark, "3; 1;;2 ", T.split_ids) == [3, 1, 2]
    assert one(spark, "abcdef", lambda c: T.clamped_slice(c, F.lit(-2), F.lit(3))) == "abc"
    assert one(spark, "abcdef", lambda c: T.clamped_slice(c, F.lit(4), F.lit(99))) == "ef"


@pytest.mark.parametrize("raw, tag", [("the use of the word", "ENGLISH"), ("der und die", "GERMAN"), ("el perro y los gatos", "SPANISH"), ("les chats et le chien", "FRENCH"), ("物理学", "CHINESE"), ("ひらがな", "JAPANESE"), ("физика", "RUSSIAN"), ("xyz", "UNKNOWN"), (None, "UNKNOWN")])
def test_language(spark, raw, tag):
    assert one(spark, raw, T.language) == tag
