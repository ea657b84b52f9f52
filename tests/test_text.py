"""Golden lines of the text functions."""

import random
import re
import timeit

import pytest
from pyspark.sql import functions as F

from lograin import Params
from lograin.functions import patterns as P
from lograin.functions import text as T


def evaluate(spark, values, function):
    rows = spark.createDataFrame(list(enumerate(values)), "no int, content string")
    return [row[0] for row in rows.orderBy("no").select(function(F.col("content"))).collect()]


def keys(spark, lines, id_log="host", words=()):
    params = Params(id_log=id_log, words=words)
    return evaluate(spark, lines, lambda c: T.cluster_key(c, F.lit(id_log), params))


LEVEL_LINES = {
    "debug: Gateway connection trace": "DEBUG{}: gateway connection trace",
    "info: User Logged": "INFO{}: user logged",
    "notice: System update available": "NOTICE{}: system update available",
    "warning: High memory usage": "WARNING{}: high memory usage",
    "warn: Disk space low": "WARN{}: disk space low",
    "error: Gateway terminated": "ERROR{}: gateway terminated",
    "critical: Hardware failure detected": "CRITICAL{}: hardware failure detected",
    "alert: Intrusion attempt blocked": "ALERT{}: intrusion attempt blocked",
    "emergency: Kernel panic, system halting": "EMERGENCY{}: kernel panic, system halting",
}


@pytest.mark.parametrize("id_log, prefix", [("null", ""), ("host", "null_*   ")])
def test_level_lines(spark, id_log, prefix):
    lines = [f"null_12 Aug 22, 2022 23:59:59 {text} %d 128.24.49.22" for text in LEVEL_LINES]
    assert keys(spark, lines, id_log) == [key.format(prefix) + " %d" for key in LEVEL_LINES.values()]


def test_cluster_key_corner_cases(spark):
    golden = {
        "2024-01-02T03:04:05.123Z WARN disk 93% on 10.0.0.1:8080": "WARNt.*z  disk *% on :*",
        "Warnings abound error_5 INFO": "INFOwarnings abound error_*",
        "12-2024-01 alert!": "ALERT!",
        "": "",
        "\xa0\x0b　 \t": "",
        "error: error took 5 ms": "ERROR:  took * ms",
        "éerror x": "ERRORé x",
        "999.1.1.1 x": "x",
        "a1.2.3.4 1.2.3.4.5": "a*.*.*.* .*",
    }
    assert keys(spark, list(golden)) == list(golden.values())


def test_log_id_is_the_configured_one_and_case_sensitive(spark):
    params = Params(id_log="a.b")
    lines = ["xa.b_1234567890 a+b_1 A.B_1", "a.b_"]
    cut = evaluate(spark, lines, lambda c: T.strip_log_id(c, F.lit("other"), params))
    assert cut == ["x0 a+b_1 A.B_1", "a.b_"]
    assert evaluate(spark, lines, lambda c: T.strip_log_id(c, F.lit(""), params)) == lines


def test_remove_words_is_one_pass_with_list_order(spark):
    params = Params(words=("ab", "", "abc", "$1", "b"))
    lines = ["abcab", "aabb", "x$1y", "Ab"]
    assert evaluate(spark, lines, lambda c: T.remove_words(c, params)) == ["c", "a", "xy", "A"]
    assert evaluate(spark, lines, lambda c: T.remove_words(c, Params())) == lines


def removed(text, words):
    """At each position the first listed word that stands there goes."""
    out, at = [], 0
    while at < len(text):
        word = next((w for w in words if w and text.startswith(w, at)), None)
        out.append("" if word else text[at])
        at += len(word) if word else 1
    return "".join(out)


@pytest.mark.parametrize("letters", ["ab", "a.$", "é😀]\\^-["])
def test_word_lists_keep_their_order(spark, letters):
    rng = random.Random(letters)

    def text(most):
        return "".join(rng.choice(letters) for _ in range(rng.randrange(most)))

    for _ in range(6):
        words = tuple(text(6) for _ in range(rng.randrange(1, 25)))
        lines = [text(40) for _ in range(50)]
        assert evaluate(spark, lines, lambda c: T.remove_words(c, Params(words=words))) == [removed(line, words) for line in lines]


def test_a_long_list_costs_about_as_much_as_a_short_one(spark):
    """No choice of the pattern is among more alternatives than there are first letters."""
    words = tuple(f"{chr(97 + i % 26)}{i * 7919 % 100_003:05}x" for i in range(10_000))
    lines = ["plain words of a line 12345 and so on", f"a {words[77]}b{words[9000]}"] * 200
    assert evaluate(spark, lines, lambda c: T.remove_words(c, Params(words=words))) == [lines[0], "a b"] * 200
    # Python's engine needs another spelling of code points, and goes through alternatives in order as well
    patterns = [re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), P.any_word(some))) for some in (words, words[:10])]
    took = [min(timeit.repeat(lambda: [p.sub("", line) for line in lines], number=5, repeat=3)) for p in patterns]
    assert took[0] < 20 * took[1]
    assert P.any_word(("", "")) == "" and P.any_word(["x" * 5000]).count("x") > 4990


def test_trim_space(spark):
    space = " \x85\v\f\r\n "
    assert evaluate(spark, [f"{space}a b{space}", "​x"], T.trim_space) == ["a b", "​x"]


def test_extract_level(spark):
    lines = ["a Warning b error", "error_1", "nowarn", "(INFO)", "alertalert"]
    assert evaluate(spark, lines, T.extract_level) == ["WARNING", "", "", "INFO", ""]


def test_first_ip(spark):
    golden = {
        "a 10.0.0.1 b": "10.0.0.1",
        "x 10.0.0.5/24": "10.0.0.5",
        "10.0.0.1:80 1.2.3.4": "1.2.3.4",
        "256.1.1.1 01.2.3.4": None,
        "1.2.3.4/33 5.6.7.8": "5.6.7.8",
        "1.2.3.4, (1.2.3.4) 1.2.3": None,
        "at　1.2.3.4\xa0end": "1.2.3.4",
        "from ::1 to": "::1",
        "2001:db8::ff/64": "2001:db8::ff",
        "1:2:3:4:5:6:7:8 x": "1:2:3:4:5:6:7:8",
        "1:2:3:4:5:6:7:8:9 12:30:45": None,
        "1::2::3 ::ffff:1.2.3.4": "::ffff:1.2.3.4",
        "::": "::",
        "1:2:3:4:5:6:7::": "1:2:3:4:5:6:7::",
        "1.2.3.4/024": "1.2.3.4",
    }
    assert evaluate(spark, list(golden), T.first_ip) == list(golden.values())
