import bz2
import gzip
import io
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from itemloom.model import CsvOptions, Field, FieldType, StageNote
from itemloom.operators.rules import rule_measures
from itemloom.sources import delimited, export, narrow, streams, triples

ROWS = (
    "\n\n  id,name , note\n"
    '1, plain ,"two\n   lines"\n'
    "\n"
    '2,"with ""quotes"" inside", last \n'
    '3,"a,b",\n'
)
EXPECTED = [
    ("1", "plain", "two lines"),
    ("2", 'with "quotes" inside', "last"),
    ("3", "a,b", ""),
]


def write(path, data: bytes):
    path.write_bytes(data)
    return str(path)


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_csv_quotes_lines_and_blanks(spark, tmp_path):
    read = delimited.read_csv(spark, write(tmp_path / "a.csv", ROWS.encode()))
    assert read.columns == ["id", "name", "note"]
    assert rows(read) == EXPECTED


@pytest.mark.parametrize("kind", ["gzip", "bzip2", "zip"])
def test_compressed(spark, tmp_path, kind):
    data = ROWS.encode()
    if kind == "gzip":
        path = write(tmp_path / "a.csv.gz", gzip.compress(data))
    elif kind == "bzip2":
        path = write(tmp_path / "a.csv.bz2", bz2.compress(data))
    else:
        path = str(tmp_path / "a.zip")
        with zipfile.ZipFile(path, "w") as archive:
            archive.writestr("first.csv", data)
            archive.writestr("second.csv", "ignored")
    assert rows(delimited.read_csv(spark, path, CsvOptions(compression=kind))) == EXPECTED


def test_several_zip_files_keep_their_headers_apart(spark, tmp_path):
    for i in range(3):
        with zipfile.ZipFile(tmp_path / f"{i}.zip", "w") as archive:
            archive.writestr("x.csv", f"id,name\n{i},n{i}\n")
    read = delimited.read_csv(spark, str(tmp_path), CsvOptions(compression="zip"))
    assert rows(read) == [("0", "n0"), ("1", "n1"), ("2", "n2")]


def test_other_signs_and_encoding(spark, tmp_path):
    path = write(tmp_path / "a.csv", "name;x\n'é;\\'ü';1\n".encode("iso-8859-1"))
    options = CsvOptions(separator=";", quote="'", escape="\\", encoding="ISO-8859-1")
    assert rows(delimited.read_csv(spark, path, options)) == [("é;'ü", "1")]


def test_wrong_number_of_values(spark, tmp_path):
    path = write(tmp_path / "a.csv", b"a,b\n1,2\n3\n4,5,6\n")
    with pytest.raises(Exception):
        delimited.read_csv(spark, path).collect()
    kept, rejected = delimited.check_records(delimited.read_csv(spark, path, mode="PERMISSIVE"))
    assert rows(kept) == [("1", "2")]
    assert {tuple(r["errors"]) for r in rejected.collect()} == {("wrong number of values",)}
    assert rejected.count() == 2


def test_cells_that_are_too_long(spark):
    frame = spark.createDataFrame([("x" * 255,), ("x" * 256,), (None,), ("x" * 1_000_001,)], "v string")
    kept, rejected = delimited.check_records(frame)
    assert kept.count() == 2
    assert sorted(r["errors"] for r in rejected.collect()) == [
        ["cell too long"],
        ["cell too long", "record too long"],
    ]


def test_column_names_are_checked(spark):
    with pytest.raises(ValueError):
        delimited.check_records(spark.createDataFrame([("x",)], f"{'n' * 256} string"))


def test_preview(spark, tmp_path):
    path = write(tmp_path / "a.txt", b"one\ntwo\nthree\n")
    assert [r[0] for r in delimited.preview(spark, path, 2).collect()] == ["one", "two"]
    with pytest.raises(Exception):
        delimited.preview(spark, path, 2, max_bytes=4).collect()


class Endless(io.RawIOBase):
    """A line without an end that counts how much of it was read."""

    def __init__(self):
        self.given = 0

    def readable(self):
        return True

    def readinto(self, buffer):
        buffer[:] = b"x" * len(buffer)
        self.given += len(buffer)
        return len(buffer)


def test_a_line_without_an_end_is_given_up_after_its_share():
    source = Endless()
    with pytest.raises(ValueError, match="longer than 1000 bytes"):
        list(streams.bounded_lines(io.BufferedReader(source), "UTF-8", 1000))
    assert source.given <= 100_000


@pytest.mark.parametrize("kind", [None, "gzip", "bzip2", "zip"])
def test_preview_of_one_huge_line(spark, tmp_path, kind):
    """20 MB without a line break, also packed into a few kilobytes, end at the share of a line."""
    data = b"first\n" + b"x" * 20_000_000
    if kind == "zip":
        with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("a.txt", data)
            archive.writestr("b.txt", b"other entry")
        path = str(tmp_path / "a.zip")
    else:
        packed = {None: bytes, "gzip": gzip.compress, "bzip2": bz2.compress}[kind](data)
        path = write(tmp_path / f"a.{kind}", packed)
    assert [r[0] for r in delimited.preview(spark, path, 1, compression=kind).collect()] == ["first"]
    with pytest.raises(Exception, match="longer than 500000 bytes"):
        delimited.preview(spark, path, 2, compression=kind)


@pytest.mark.parametrize("kind", ["gzip", "bzip2", "zip"])
def test_streams_of_lines(spark, tmp_path, kind):
    """Line ends of three kinds, members and streams in a row, an empty file, another encoding."""
    data = "é one\r\ntwo\rthree\n\nlast".encode("iso-8859-1")
    if kind == "zip":
        with zipfile.ZipFile(tmp_path / "a", "w") as archive:
            archive.writestr("x", data)
        with zipfile.ZipFile(tmp_path / "b", "w") as archive:
            archive.writestr("x", b"")
    else:
        pack = gzip.compress if kind == "gzip" else bz2.compress
        write(tmp_path / "a", pack(data[:8]) + pack(data[8:]))
        write(tmp_path / "b", pack(b""))
    files = [str(tmp_path / "a"), str(tmp_path / "b")]
    found = streams.stream_lines(spark, files, kind, "ISO-8859-1")
    expected = [(files[0], i, v) for i, v in enumerate(["é one", "two", "three", "", "last"], 1)]
    assert found.rdd.getNumPartitions() == 2 and rows(found) == sorted(expected)
    assert rows(streams.stream_lines(spark, files, kind, "ISO-8859-1", lines=2)) == sorted(expected[:2])
    with pytest.raises(ValueError):
        streams.stream_lines(spark, files, "rar")


def test_an_archive_without_entries(spark, tmp_path):
    zipfile.ZipFile(tmp_path / "a.zip", "w").close()
    with pytest.raises(Exception, match="entries"):
        streams.stream_lines(spark, [str(tmp_path / "a.zip")], "zip").collect()


def test_zip_files_and_joined_files_round_trip(spark, tmp_path):
    lines = spark.range(5_000).select(F.concat(F.lit("é"), F.col("id")).alias("v")).repartition(6)
    streams.write_zip(lines, f"file://{tmp_path}/zips", "v")
    read = delimited.read_csv(spark, f"{tmp_path}/zips/*.zip", CsvOptions(compression="zip"))
    assert read.exceptAll(lines).count() == 0 and read.count() == 5_000
    ordered = spark.range(5_000).repartitionByRange(6, "id").sortWithinPartitions("id").select(F.col("id").cast("string").alias("v"))
    path = streams.write_joined(ordered, str(tmp_path / "joined"), "all.txt", "head\n", "tail\n")
    with open(path) as file:
        assert file.read().splitlines() == ["head", *map(str, range(5_000)), "tail"]


def test_one_document_with_all_lists(spark, tmp_path):
    """Rules of length 3 with signs that XML has to escape, notes, and a document without rules."""
    item_values = spark.createDataFrame([(1, 1, "x<&>"), (2, 2, '"y"'), (3, 3, "é")], "item long, attribute int, value string")
    names = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "attribute int, name string")
    found = spark.createDataFrame([([1, 2], [3], 4, 5, 6, 10), ([], [3], 6, 10, 6, 10)], "antecedent array<long>, consequent array<long>, n_both long, n_left long, n_right long, n long")
    found = rule_measures(found)
    path = export.write_rules_document(found, item_values, names, str(tmp_path / "r"), [StageNote("timeout", 4, 2)])
    model = ElementTree.parse(path).getroot()
    assert {(e.get("name"), e.get("value")) for e in model.iter("{http://www.dmg.org/PMML-4_0}Extension")} == {
        ("number-of-rules", "2"),
        ("timeout-with-rulelength", "4"),
        ("timeout-with-size", "2"),
    }
    assert [(e.get("id"), e.find("FieldRef").text, e.find("CatRef").text) for e in model.iter("BBA")] == [
        ("BBA1", "a", "x<&>"),
        ("BBA2", "b", '"y"'),
        ("BBA3", "c", "é"),
    ]
    (compound,) = model.iter("DBA")
    assert [e.text for e in compound.iter("BARef")] == ["BBA1", "BBA2"]
    listed = {e.get("antecedent"): e for e in model.iter("AssociationRule")}
    assert set(listed) == {None, compound.get("id")} and listed[None].get("consequent") == "BBA3"
    assert [listed[compound.get("id")].find("FourFtTable").get(x) for x in "abcd"] == ["4", "1", "2", "3"]
    empty = export.write_rules_document(found.limit(0), item_values, names, str(tmp_path / "none"))
    assert not list(ElementTree.parse(empty).getroot().iter("BBA"))


def test_preview_of_several_files(spark, tmp_path):
    write(tmp_path / "b.txt", b"three\nfour\n")
    write(tmp_path / "a.txt", b"one\ntwo\n")
    assert [r[0] for r in delimited.preview(spark, str(tmp_path), 3).collect()] == ["one", "two", "three"]


def test_options_of_a_scan(spark, tmp_path):
    path = write(tmp_path / "a.csv", b"x,y,z\n1,?,a\n?,2,b\n")
    options = CsvOptions(null_values=frozenset({"?"}), types=(FieldType.NUMERIC, None, FieldType.NOMINAL))
    assert rows(delimited.read_csv(spark, path, options).fillna("-")) == [("-", "b"), ("1", "a")]


def test_select_fields(spark):
    frame = spark.createDataFrame([("a", "b", "c")], "x string, y string, z string")
    kept, fields = narrow.select_fields(frame, [FieldType.NOMINAL, None, FieldType.NUMERIC])
    assert kept.columns == ["x", "z"]
    assert fields == [Field(1, "x", FieldType.NOMINAL), Field(2, "z", FieldType.NUMERIC)]
    with pytest.raises(ValueError):
        narrow.select_fields(frame, [FieldType.NOMINAL])
    with pytest.raises(ValueError):
        narrow.select_fields(frame, [None, None, None])


def test_missing_cells_are_absent(spark):
    frame = spark.createDataFrame([(1, " x "), (2, "?"), (3, "5")], "id long, v string")
    cleaned = narrow.apply_null_tokens(frame, ["?", "NA"], ["v"])
    cells = narrow.to_instances(cleaned, "id", [Field(7, "v", FieldType.NOMINAL)])
    assert rows(cells.fillna(-1.0)) == [(1, 7, "x", -1.0), (3, 7, "5", 5.0)]


def test_row_ids_over_several_ranges(spark):
    import itemloom.runtime as runtime

    frame = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("key")).repartition(7)
    numbered = runtime.number_rows(frame, ["key"], "n", start=3)
    found = [tuple(r) for r in numbered.orderBy("key").select("n").collect()]
    assert found == [(i,) for i in range(3, 5003)]


LINES = [
    "# comment",
    "",
    "<urn:s1> <urn:p> <urn:o> .",
    '<urn:s1> <urn:q> "12.5"^^<http://www.w3.org/2001/XMLSchema#double> .',
    '<urn:s2> <urn:q> "7"@en <urn:graph> . # quad',
    r'<urn:s2> <urn:p> "tab\there \"q\" \\n é \U0001F600" .',
    '<urn:s2> <urn:p> "" .',
    r"<urn:é> <urn:p> <urn:o> .",
    "<urn:s1> <urn:p> <urn:o> .",
]


def parsed(spark, lines, **options):
    return triples.parse_triples(spark.createDataFrame([(x,) for x in lines], "value string"), **options)


def test_triples(spark):
    found = rows(parsed(spark, LINES).fillna(-1.0).distinct())
    assert found == sorted(
        [
            ("urn:s1", "urn:p", "urn:o", -1.0, True),
            ("urn:s1", "urn:q", "12.5", 12.5, False),
            ("urn:s2", "urn:q", "7", 7.0, False),
            ("urn:s2", "urn:p", 'tab\there "q" \\n é 😀', -1.0, True),
            ("urn:s2", "urn:p", "", -1.0, True),
            ("urn:é", "urn:p", "urn:o", -1.0, True),
        ]
    )


@pytest.mark.parametrize("line", ["_:b <urn:p> <urn:o> .", "<urn:s> <urn:p> _:b .", "nonsense"])
def test_bad_triples(spark, line):
    with pytest.raises(Exception):
        parsed(spark, [line]).collect()
    assert parsed(spark, [line, LINES[2]], mode="DROPMALFORMED").count() == 1


def test_transactions_of_triples(spark):
    read = parsed(spark, LINES)
    fields = triples.triples_fields(read)
    assert rows(fields) == [(1, "urn:p", "NOMINAL"), (2, "urn:q", "NUMERIC")]
    cells = rows(triples.triples_instances(read, fields).select("id", "field", "value_nominal"))
    # the repeated triple collapses, several values of a field stay
    assert cells == [
        (1, 1, "urn:o"),
        (1, 2, "12.5"),
        (2, 1, ""),
        (2, 1, 'tab\there "q" \\n é 😀'),
        (2, 2, "7"),
        (3, 1, "urn:o"),
    ]
