import pytest

from itemloom.errors import ValidationError
from itemloom.functions import evaluate
from itemloom.functions.values import checked, number, number_text, order_key, text_of
from itemloom.plans import expressions as X
from itemloom.plans.keys import Key, bounds

V = {":a": {"N": "1"}, ":b": {"N": "2"}, ":s": {"S": "x"}, ":set": {"SS": ["x", "y"]}, ":l": {"L": [{"N": "1"}]}, ":t": {"S": "N"}}
ITEM = {"n": {"N": "1"}, "m": {"N": "10"}, "s": {"S": "xyz"}, "tags": {"SS": ["x"]}, "nul": {"NULL": True}, "list": {"L": [{"N": "1"}, {"S": "x"}]}, "bin": {"B": "YQ=="}}


@pytest.mark.parametrize(
    "text,want",
    [
        ("n = :a", True), ("n <> :a", False), ("gone <> :a", False), ("NOT gone = :a", True), ("n < m", True), ("s < n", False), ("NOT s < n", True),
        ("n = :a AND m = :a OR s = :s", False), ("n = :a AND (m = :a OR s > :s)", True), ("attribute_exists(nul)", True), ("attribute_not_exists(gone)", True),
        ("begins_with(s, :s)", True), ("begins_with(bin, :s)", False), ("contains(s, :s)", True), ("contains(tags, :s)", True), ("contains(#list, :a)", True), ("contains(n, :a)", False),
        ("attribute_type(n, :t)", True), ("attribute_type(s, :t)", False), ("n BETWEEN :a AND :b", True), ("m between :a and :b", False), ("n IN (:b, :a)", True), (":a = n", True), (":b <= m", True),
        ("not n = :b and not (m = :a or s = :s)", True), ("nul = :a", False), ("NOT (n = :a)", False),
    ],
)
def test_conditions(text, want):
    assert evaluate.holds(X.condition(text, {"#list": "list"}, V), ITEM) is want


@pytest.mark.parametrize("text", ["", "n =", "n = :zz", "#q = :a", "a.b = :a", "a[0] = :a", "size(n) = :a", "n = :a AND", "(n = :a", "n = :a)", "status = :a", "n ! :a", "attribute_exists(:a)", "n IN ()"])
def test_bad_conditions(text):
    with pytest.raises(ValidationError):
        X.condition(text, None, V)


def test_names_with_and_without_their_sign():
    assert X.condition("#status = :v", {"status": "status"}, {"v": {"N": "1"}}) == X.condition("#status = :v", {"#status": "status"}, {":v": {"N": "1"}})


@pytest.mark.parametrize(
    "text,want",
    [
        ("SET n = m, m = n", {"n": {"N": "10"}, "m": {"N": "1"}}), ("SET n = n + :b REMOVE s", {"n": {"N": "3"}, "s": None}), ("SET q = if_not_exists(q, :a)", {"q": {"N": "1"}}), ("SET q = if_not_exists(n, :b)", {"q": {"N": "1"}}),
        ("SET #list = list_append(#list, :l)", {"list": {"L": [{"N": "1"}, {"S": "x"}, {"N": "1"}]}}), ("ADD n :b", {"n": {"N": "3"}}), ("ADD q :b", {"q": {"N": "2"}}), ("ADD tags :set", {"tags": {"SS": ["x", "y"]}}), ("DELETE tags :set", {"tags": None}),
        ("DELETE gone :set REMOVE gone", {"gone": None}), ("SET n = m - n", {"n": {"N": "9"}}),
    ],
)
def test_updates(text, want):
    out = evaluate.updated(X.update(text, {"#list": "list"}, V), ITEM)
    assert {k: out.get(k) for k in want} == want and {k: v for k, v in out.items() if k not in want} == {k: v for k, v in ITEM.items() if k not in want}


@pytest.mark.parametrize("text", ["", "SET", "SET n = :a SET m = :a", "ADD n :s", "DELETE n :a", "FOO n", "SET n.x = :a", "SET n = foo(:a)", "REMOVE :a"])
def test_bad_updates(text):
    with pytest.raises(ValidationError):
        X.update(text, None, V)


@pytest.mark.parametrize("text", ["SET n = gone", "SET n = s + :a", "ADD s :a", "ADD n :set", "DELETE n :set", "SET n = list_append(n, :l)"])
def test_updates_that_fail_on_the_item(text):
    with pytest.raises(ValidationError):
        evaluate.updated(X.update(text, None, V), ITEM)


def test_projection():
    assert X.projection(" a, b ,#c, a", {"#c": "count"}) == ["a", "b", "count"] and X.projection("  ") is None
    for bad in ("a,", "a.b", "count"):
        with pytest.raises(ValidationError):
            X.projection(bad)


def test_key_conditions():
    pk, sk = Key("id", "S"), Key("ts", "N")
    one = lambda t, s=sk: bounds(X.condition(t, None, V), pk, s)
    assert one("id = :s").sk is None and one("id = :s AND ts < :a").sk == ("<", ({"N": "1"},)) and one("id = :s AND :a < ts").sk[0] == ">"
    assert one("id = :s AND ts BETWEEN :a AND :b").sk[0] == "BETWEEN" and one("id = :s AND begins_with(ts, :s)", Key("ts", "S")).sk[0] == "begins_with"
    for bad in ("ts = :a", "id = :a", "id < :s", "id = :s OR ts = :a", "NOT id = :s", "id = :s AND ts <> :a", "id = :s AND n = :a", "id = :s AND ts IN (:a)", "id = :s AND begins_with(ts, :s)", "id = ts", "id = :s AND ts = :a AND n = :a", "id = :s AND ts = :s"):
        with pytest.raises(ValidationError):
            one(bad)
    with pytest.raises(ValidationError):
        one("id = :s AND ts = :a", None)


@pytest.mark.parametrize("bad", [{}, {"Q": 1}, {"S": "a", "N": "1"}, {"N": 1}, {"BOOL": "x"}, {"NULL": False}, {"B": "*"}, {"SS": [1]}, {"L": {}}, {"M": []}, []])
def test_bad_values(bad):
    with pytest.raises(ValidationError):
        checked(bad)


def test_numbers_order_and_keep_their_digits():
    texts = ["-1e20", "-123.5", "-123.4999", "-1", "-0.001", "0", "1e-30", "0.001", "0.5", "1", "1.5", "9.99", "10", "123456789012345678901234567890", "1e100"]
    assert sorted(texts, key=order_key) == texts and order_key("1.0") == order_key("1") == order_key("10e-1")
    assert number_text(number("1234567890123456789012345") + 0) == "1234567890123456789012345" and number_text(number("15.0")) == "15"
    assert evaluate.added({"N": "0.1"}, {"N": "0.2"}) == {"N": "0.3"} and text_of({"M": {"b": {"N": "1"}, "a": {"S": "é"}}}) == '{"M":{"a":{"S":"é"},"b":{"N":"1"}}}'
