from __future__ import annotations

import datetime as dt

from tracewarden.sources.access_log import numbered_rejects, parse_lines, parse_rejects, read_lines

LINES = [
    "2026-04-01T09:00:01Z 185.23.44.12 get /accounts 200 1019 PostmanRuntime/7.39.0  x ",
    '10.64.65.169 - - [15/Nov/2024:09:00:08 +0500] "post /api/v1/login HTTP/1.1" 200 3305 "-" "Mozilla/5.0" extra',
    '10.64.65.169 - - [1/Nov/2024:09:00:08 +05:00] "POST /a b HTTP/1.1" 200 3305 "-" ""',
    '10.64.65.169 - - [99/Nov/2024:09:00:08 +0500] "POST /x HTTP/1.1" 200 3305 "-" "M"',
    "# comment",
    "   ",
    "garbage 1",
    "2026-04-01T09:00:01.25+05:00 1.1.1.1 GET / 200 1 x",
    "2026-04-01T09:00:02 1.1.1.1 GET / 200 1 x",
    "bad 1.1.1.1 GET / 200 1 x",
    "2026-04-01T09:00:03Z 1.1.1.1 GET / 99999999999 1 x",
]


def _write(tmp_path, data: bytes) -> str:
    (tmp_path / "a.log").write_bytes(data)
    return str(tmp_path)


def test_both_formats_in_one_file(spark, tmp_path):
    lines = read_lines(spark, _write(tmp_path, "\n".join(LINES).encode()))
    got = [tuple(r)[1:] for r in parse_lines(lines).drop("file").orderBy("lineno").collect()]
    day = lambda *a: dt.datetime(*a)
    assert got == [
        (day(2026, 4, 1, 9, 0, 1), "185.23.44.12", "get", "/accounts", 200, 1019, "PostmanRuntime/7.39.0  x"),
        (day(2024, 11, 15, 4, 0, 8), "10.64.65.169", "POST", "/api/v1/login", 200, 3305, "Mozilla/5.0"),
        (day(2024, 11, 1, 4, 0, 8), "10.64.65.169", "POST", "/a b", 200, 3305, ""),
        (day(2026, 4, 1, 4, 0, 1, 250000), "1.1.1.1", "GET", "/", 200, 1, "x"),
        (day(2026, 4, 1, 9, 0, 2), "1.1.1.1", "GET", "/", 200, 1, "x"),
    ]


def test_rejects_have_reason_and_true_line_number(spark, tmp_path):
    lines = read_lines(spark, _write(tmp_path, "\n".join(LINES).encode()))
    got = numbered_rejects(parse_rejects(lines), lines).orderBy("lineno").collect()
    assert [(r.lineno, r.reason) for r in got] == [(4, "bad time"), (7, "no match"), (10, "bad time"), (11, "bad number")]


def test_line_numbers_over_split_files(spark, tmp_path):
    n = 60_000
    body = "".join(f"garbage {i}\n" if i % 5_000 == 0 else f"# filler line number {i:030d} {'x' * 40}\n" for i in range(1, n))
    (tmp_path / "big.log").write_text(body)
    (tmp_path / "small.log").write_text("garbage\n# x\ngarbage\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        lines = read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 3
        rows = numbered_rejects(parse_rejects(lines), lines).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    big = {(r.lineno, r.value) for r in rows if r.file.endswith("big.log")}
    assert big == {(i, f"garbage {i}") for i in range(5_000, n, 5_000)}
    assert sorted(r.lineno for r in rows if r.file.endswith("small.log")) == [1, 3]


def test_bad_bytes_and_line_ends(spark, tmp_path):
    data = b"2026-04-01T09:00:01Z 1.1.1.1 GET /\xff 200 1 x\r\n2026-04-01T09:00:01Z 1.1.1.1 GET /b 200 1 y\r"
    got = parse_lines(read_lines(spark, _write(tmp_path, data))).orderBy("lineno").collect()
    assert [(r.url_full, r.user_agent) for r in got] == [("/�", "x"), ("/b", "y")]


def test_empty_input_keeps_the_schema(spark, tmp_path):
    from tracewarden.operators.enrich import enrich
    from tracewarden.schema import REQUEST_COLUMNS

    df = enrich(parse_lines(read_lines(spark, _write(tmp_path, b""))))
    assert df.count() == 0 and df.columns == ["file", *REQUEST_COLUMNS]


def test_unicode_white_space_separates(spark, tmp_path):
    line = "2026-04-01T09:00:01Z 1.1.1.1 GET\x1f/b 200 1 y"
    got = parse_lines(read_lines(spark, _write(tmp_path, line.encode()))).collect()
    assert [(r.ip, r.method, r.url_full) for r in got] == [("1.1.1.1", "GET", "/b")]


def test_filters_do_not_repeat_the_regexes(spark, tmp_path):
    plan = parse_lines(read_lines(spark, _write(tmp_path, b"x")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 3  # one per format and the trimming of custom agents
