"""Field names of any length."""

from __future__ import annotations

import time

import pytest

from bhashaloom.llm import residue as R

LONG = "order.customer.billing_address.primary_street_line_1"


@pytest.mark.parametrize("name", [LONG, "customer" * 8 + "_name", "name", "_".join(["part"] * 300)])
@pytest.mark.parametrize("form", ["{{ %s }}", "{{#%s}}", "{{ %s|upper }}", "${%s}", "#{ %s }", "{%s}", "{$%s}", "<<%s>>", "«%s»", "[[%s]]", "__%s__", "@@%s@@", "##%s##", "%%%s%%", "%%(%s)s", "[%s]"])
def test_name_of_any_length(form, name):
    assert R.residue_kind(f"The town {form % name} has a river.") == "field"


def test_names_with_spaces():
    assert R.residue_kind("Dear {{ first name of the customer who ordered the goods last week }}, hello.") == "field"


def test_prose_is_no_name():
    prose = "the river that runs through the town and on to the sea"
    assert [x for x in (f"So [[ {prose} ]] it is.", f"He said <<{prose}>> there.", f"It is [{prose}] there.", "Sign here: " + "_" * 60 + " please.", f"«{'水' * 50}» is said.", f"[{'水' * 50}] is said.") if R.residue_kind(x)] == []


def test_long_runs_take_no_time():
    began = time.process_time()
    for part in ("{{ a ", "{{ a" + " " * 50, "__a.", "__a._", "%a", "[a.", "[[a b", "<< a_", "${a ", "{a_", "@@a", "##a.", "__"):
        R.residue_kind(part * (200_000 // len(part)))
    R.residue_kind("{{ a" + " " * 200_000)
    assert time.process_time() - began < 20


def test_nothing_is_cut_short():
    from bhashaloom.llm.residue import residue_kind

    name = "a" * 90
    for text in (f"<< {name} >>", f"«{name}»", f"[[{name}]]", f"[{name}]", f"<insert {name} of {name}>", f"[enter {name} and {name}]", f"__{name}__"):
        assert residue_kind(f"Dear {text}, welcome to the village.") == "field", text
    quoted = "word " * 40 + "{{ name }} " + "word " * 10
    assert residue_kind(f'The manual says "{quoted}" and so on for everybody who reads it.') is None
    menu = " | ".join(["A rather long entry of a menu that names a part of the site", "Another entry that is nearly as long as the first one"])
    assert residue_kind(f"{menu}\nError 404: page not found.") == "message"
