"""Secrets behind a name and '=' without spaces, and runs of digits."""

import pytest

from evalgrove.llm import secrets

KEY = "8fJ2kQ9xZ7vB4nM1pL6t"


@pytest.mark.parametrize(
    ("text", "secret"),
    [(f"AWS_SECRET_ACCESS_KEY={KEY}", KEY), (f"SIGNING_KEY={KEY}", KEY), (f"client_auth={KEY}", KEY), (f"see ?auth={KEY} there", KEY), (f"SIGNING_KEY={KEY}==", f"{KEY}=="), (f"the key is {KEY}=", f"{KEY}="), ("login=8305719264408127365", "8305719264408127365"), ("the key is 8305719264408127365", "8305719264408127365")],
)
def test_value_of_an_assignment_is_found(text, secret):
    at = text.index(secret)
    assert secrets.find(text, secrets.Novelty()) == [(at, at + len(secret), "novel")]


@pytest.mark.parametrize("text", [f"NAME={KEY}", "private key of internationalization", "SIGNING_KEY=configurationendpoint", "key=4111111111111111"])
def test_others_are_left_alone(text):
    assert secrets.find(text, secrets.Novelty()) == []
