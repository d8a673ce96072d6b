import json

import pytest
from clearveil.sources import rules as ru


def test_json_rules():
    got = ru.from_json(json.dumps([{"name": "a", "value": "12-34 é"}, {"name": "b", "pattern": r"x\d+"}, {"name": "c", "class": "ssn"}, {"name": "d", "class": "email", "strict": True}]))
    assert got.values() == [("a", "1234e")]
    assert got.informational() == {"c"} and got.informational(strict_classes=True) == set()


@pytest.mark.parametrize("rows", [[], {}, [{"name": "a"}], [{"name": "a", "value": "---"}], [{"name": "a", "pattern": "x*"}], [{"name": "a", "pattern": "("}], [{"name": "a", "class": "iban"}], [{"name": "a", "value": "x", "pattern": "y"}], [{"name": "a", "value": "x"}] * 2, [{"name": "a", "value": "x", "strict": True}], [{"name": "a", "class": "ssn", "strict": 1}], [{"name": "a", "pattern": "(?P<n>x)"}]])
def test_json_refusals(rows):
    with pytest.raises(ru.RuleError):
        ru.from_json(json.dumps(rows))


def test_yaml_rules():
    got = ru.from_yaml("exact_values:\n  - 0123\n  - Ab c\npatterns:\n  - 'k\\d'\nother: 1\n")
    assert got.values() == [("exact_values[0]", "0123"), ("exact_values[1]", "abc")]
    assert got.warnings == ("unknown section: other",)


@pytest.mark.parametrize("text", ["", "- a", "exact_values: x", "exact_values: []", "exact_values: [a]\nexact_values: [b]", "patterns: ['']"])
def test_yaml_refusals(text):
    with pytest.raises(ru.RuleError):
        ru.from_yaml(text)
