"""Surrogates of very long texts, possessives, titles and suffixes."""

import re
import time

import pytest

from causeway.llm import op9_surrogates

LONG = {
    "mail": "write to a@b" + ".cd" * 100_000, "mail name": "x." * 200_000 + "@y.org", "hyphens": "Mr Anna" + "-a" * 100_000, "apostrophes": "Dr O'Ab" + "'c" * 100_000, "second form": "Mr O'Brien" + "-Ab" * 100_000, "phone": "+1" + " 22" * 100_000, "digits": "2" * 400_000,
    "account": "DE12" + " ABCD" * 100_000, "secret": "password=" + "a1" * 100_000, "secrets": "password=" * 50_000, "hex": "ab" * 200_000, "groups": "1:" * 200_000, "titles": "Mr " * 200_000, "particles": "Mr " + "van " * 200_000, "key": "sk-" * 200_000, "initials": "Dr J. and Mr K.",
}


def replaced(spark, rows):
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    return {r.doc_id: r for r in op9_surrogates.surrogates(table, "k").collect()}


def test_long_runs_of_each_pattern(spark):
    got = replaced(spark, LONG.values())
    assert len(got) == len(LONG)
    assert "a@b.cd" not in got[0].text and got[0].n_entities == 1 and got[2].text != LONG["hyphens"] and got[5].n_entities >= 1


def test_many_mentions_take_time_in_proportion(spark):
    took = []
    replaced(spark, ["Mr Smith " * 10])
    for n in (30_000, 120_000):  # the longer one is a text of a megabyte
        began = time.perf_counter()
        got = replaced(spark, ["Mr Smith " * n + "and SMITH"])[0]
        took.append(time.perf_counter() - began)
        assert got.n_entities == n + 1 and got.n_distinct == 1 and "Smith" not in got.text
        words = got.text.split()
        assert set(words[1:-2:2]) == {words[1]} and words[-1] == words[1].upper()
    assert took[1] <= 8 * took[0] + 5, took


def test_many_names_in_one_text(spark):
    names = [f"{a}{b}{c}elton" for a in "BCDFGHKLMN" for b in "aeiouy" for c in "bdfgklmnprst"]
    got = replaced(spark, [", ".join(f"Mr {n}" for n in names) + "; " + " ".join(names)])[0]
    words = re.findall(r"Mr (\w+)", got.text)
    assert len(set(words)) == len(names) and got.text.split("; ")[1].split() == words


@pytest.mark.parametrize("apostrophe", ["'", "’"])
def test_possessives_and_suffixes(spark, apostrophe):
    got = replaced(spark, [f"Mr. Smith{apostrophe}s dog bit Mr. Smith.", "Dear Mr Smith-Jones III, SMITH-JONES", "Dr. Иванова and Госпожа Иванова", "Доктор Иванова", "Господин Иванов", "Mr Adams Jr and Adams", f"Mr O{apostrophe}Brien{apostrophe}s"])
    one = re.fullmatch(rf"Mr\. (\w+){apostrophe}s dog bit Mr\. (\w+)\.", got[0].text)
    assert one and one[1] == one[2] != "Smith"
    two = re.fullmatch(r"Dear Mr (\w+) III, (\w+)", got[1].text)
    assert two and two[1].upper() == two[2] and "SMITH" not in two[2]
    three = re.fullmatch(r"Dr\. (\w+а) and Госпожа (\w+а)", got[2].text)
    assert three and three[1] == three[2] and got[3].text == f"Доктор {three[1]}" and got[4].text == f"Господин {three[1][:-1]}"
    assert re.fullmatch(r"Mr (\w+) Jr and \1", got[5].text) and got[6].text.endswith(f"{apostrophe}s") and "Brien" not in got[6].text


def test_plain_phone_numbers(spark):
    got = replaced(spark, ["2125557713, 212 555 7713, (212) 555-7713 and 1 212 555 7713", "1700000000 v2125557713 0125557713 12125557713000 2125557713.5 id=2125557713 price 212 555 77"])
    assert len({re.sub(r"\D", "", x)[-10:] for x in re.split(", | and ", got[0].text)}) == 1 and "7713" not in got[0].text
    assert got[1].n_entities == 0
