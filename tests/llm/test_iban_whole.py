"""Account numbers with capitals or digits behind them."""

from __future__ import annotations

from tomelight.llm import pii

IBAN = "DE89 3704 0044 0532 0130 00"


def ibans(text: str) -> list[str]:
    return [text[a:b] for kind, a, b, _ in pii.find_spans(text) if kind == "iban"]


def test_account_number_before_capitals_and_digits():
    for tail in (" PLEASE PAY TODAY AT BANK", " 1234 5678 9012 3456", " PLEASEPAYTODAYATTHEBANKOFENGLAND", " AB12 CD34 EF56", "", ".", " x", " AT"):
        assert ibans(IBAN + tail) == [IBAN], tail


def test_two_account_numbers_and_a_false_head():
    assert ibans(f"{IBAN} GB82 WEST 1234 5698 7654 32 END OF THE LIST HERE") == [IBAN, "GB82 WEST 1234 5698 7654 32"]
    assert ibans(f"NO 12 AB12 {IBAN} THANK YOU ALL") == [IBAN]
    assert ibans(IBAN.replace(" ", "") + "X") == [] and ibans("DE88 3704 0044 0532 0130 00 PLEASE PAY TODAY AT BANK") == []


def test_redaction():
    text = f"SEND TO {IBAN} PLEASE PAY TODAY AT BANK"
    assert pii.redact_text(text, pii.find_spans(text)) == "SEND TO [IBAN] PLEASE PAY TODAY AT BANK"
