import pytest

from mnemo.llm import secrets_scan


def found(text):
    base = secrets_scan.base_spans(text)
    return [text[a:b] for a, _, b in secrets_scan.added_spans(text, base)]


@pytest.mark.parametrize("value", ["tq7mzk2vbn91xw4p", "k7x2mq9vt4", "xkqjwvzbnmwrtplkjq", "correct-horse-battery-staple", "correcthorsebatterystaple", "xK9#mP2$vL7q"])
@pytest.mark.parametrize("before", ["the password is ", "passphrase is ", "login "])
def test_bare_values_are_judged_by_cost(before, value):
    assert found(f"{before}{value}, so they said") == [value]


@pytest.mark.parametrize("text", ["the password is required", "token authentication failed", "login credentials expired", "a password-protected page", "password is case-sensitive", "Pass through the internationalization layer", "secret changeme12345678"])
def test_prose_is_left_alone(text):
    assert not found(text)


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("login password: #9fK!x2Lq@vT7", "#9fK!x2Lq@vT7"),
        ("auth token: $x!9fKz2Lq@", "$x!9fKz2Lq@"),
        ("bearer token: $x!9fKz2Lq@ end", "$x!9fKz2Lq@"),
        ("pin login auth token -> '$x!9fKz2Lq@'", "$x!9fKz2Lq@"),
        ("secret short passphrase: xK9#mP2$vL7q", "xK9#mP2$vL7q"),
        ("password: xK9#token=mP2$vL7qQz", "xK9#token=mP2$vL7qQz"),
        ("password: pin:xK9#mP", "pin:xK9#mP"),
    ],
)
def test_the_nearest_name_counts(text, value):
    assert found(text) == [value]


def test_many_names_in_a_row():
    assert found("token " * 20_000 + "is tq7mzk2vbn91xw4p") == ["tq7mzk2vbn91xw4p"]
