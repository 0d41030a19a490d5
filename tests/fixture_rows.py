"""A small invented population, built around the situations a governed build has to tell apart.

Every person is a number in a role. What must come out of a build is not written down here: it is
derived from these rows by ``expected.py``.
"""

from __future__ import annotations

from veilwright.schemas import EXTRACT_COLUMNS, extract_schema
from veilwright.sources.tables import literal_relation

SPECIAL = "SPECIAL_DELETION"
FULL = "FULL_GOVERNED_OUTPUT_DELETION"

RESIDENTS = range(1, 9)  # nothing ever happens to them
MOVER, SLEEPER = 9, 10  # a changed segment; switched to inactive
UNDECIDED, HELD, REFUSED = 20, 23, 24  # asked to be deleted, without an authorized decision
MASKED, GONE = 21, 22  # SPECIAL; SPECIAL first and FULL later, under two numbers
STRANGER = 30  # has facts, but is in no customer extract
EARLY_CUTOFF = "2025-07-01 00:00:00"


def ssn(n: int, series: int = 7) -> str:
    return f"{series}{n:02d}-{10 + n:02d}-{1000 + 37 * n:04d}"


def person(n: int) -> str:
    return f"P{n:03d}"


def change_id(n: int, step: int) -> str:
    return f"chg/{n:03d}/{step}"


def request_of(n: int) -> str:
    """The change by which a person asked for deletion."""
    return next(r["customer_change_id"] for r in customers() if r["customer_id"] == person(n) and r["source_operation"] == "DELETE")


def change(n: int, step: int, op: str, when: str, number: str | None = None, active: bool = True, segment: str = "private") -> dict:
    row = {
        "customer_change_id": change_id(n, step),
        "customer_pk": str(5000 + n),
        "customer_id": person(n),
        "customer_ssn": number or ssn(n),
        "is_active": str(op == "UPSERT" and active),
        "source_operation": op,
        "source_updated_at": when,
    }
    if op == "UPSERT":
        row.update(
            first_name=f"Given-{n}",
            last_name=f"Family {n}",
            email=f"mailbox{n}@post.invalid",
            phone=f"+49-30-{700000 + n}",
            birth_date=f"{1950 + n}-11-{1 + n % 28:02d}",
            address_line1=f"Lane {n}",
            address_line2=f"Door {n}" if n % 2 else "",
            city="Nowhere",
            postal_code=f"{90000 + n}",
            country_code="de",
            customer_segment=segment,
        )
    return row


def customers() -> list[dict]:
    rows = [change(n, 1, "UPSERT", f"2025-03-{n + 1:02d}T07:30:00") for n in (*RESIDENTS, HELD, REFUSED)]
    rows += [
        change(MOVER, 1, "UPSERT", "2025-03-20T07:30:00"),
        change(MOVER, 2, "UPSERT", "2025-04-20T07:30:00", segment="business"),
        change(SLEEPER, 1, "UPSERT", "2025-03-21T07:30:00"),
        change(SLEEPER, 2, "UPSERT", "2025-05-21T07:30:00", active=False),
        change(UNDECIDED, 1, "DELETE", "2025-05-02T16:00:00"),
        change(UNDECIDED, 2, "UPSERT", "2025-08-11T16:00:00"),
        change(MASKED, 1, "UPSERT", "2025-03-22T07:30:00"),
        change(MASKED, 2, "DELETE", "2025-05-03T16:00:00"),
        change(GONE, 1, "UPSERT", "2025-03-23T07:30:00", number=ssn(GONE, 6)),
        change(GONE, 2, "DELETE", "2025-05-04T16:00:00"),
        change(HELD, 2, "DELETE", "2025-05-05T16:00:00"),
        change(REFUSED, 2, "DELETE", "2025-05-06T16:00:00"),
    ]
    return rows


def decision(revision: str, request: str, mode: str | None, recorded: str | None, **changes) -> dict:
    row = {
        "decision_revision_id": revision,
        "deletion_request_id": request,
        "decision_status": "CONFIRMED",
        "deletion_mode": mode,
        "deletion_policy_version": "CUSTOMER_DELETION_V1",
        "recorded_at": recorded,
        "decided_at": recorded,
        "decided_by_role": "desk",
        "decision_reason": "CHECKED",
        "legal_hold": "False",
    }
    row.update(changes)
    return row


def decisions() -> list[dict]:
    return [
        decision("rev-a", request_of(MASKED), SPECIAL, "2025-07-10T10:15:00"),
        decision("rev-b", request_of(MASKED), SPECIAL, "2025-07-19T10:15:00"),
        decision("rev-c", request_of(GONE), SPECIAL, "2025-06-12T10:15:00"),
        decision("rev-d", request_of(GONE), FULL, "2025-07-28T10:15:00"),
        decision("rev-e", request_of(HELD), FULL, "2025-06-13T10:15:00", legal_hold="True"),
        decision("rev-f", request_of(REFUSED), FULL, "2025-06-14T10:15:00", decision_status="REJECTED"),
    ]


def numbers_of(n: int) -> list[str]:
    """Every number a person has facts under."""
    return [ssn(n, 6), ssn(n)] if n == GONE else [ssn(n)]


WITH_FACTS = (*RESIDENTS, MOVER, SLEEPER, UNDECIDED, MASKED, GONE, HELD, REFUSED, STRANGER)


def events() -> list[dict]:
    rows = []
    for n in WITH_FACTS:
        for series, number in enumerate(numbers_of(n)):
            for k, kind in enumerate(("USAGE", "CALL", "USAGE")[: 1 + n % 3]):
                rows.append(
                    {
                        "event_id": f"ev-{n}-{series}-{k}",
                        "customer_ssn": number,
                        "event_type": kind,
                        "occurred_at": f"2025-06-{1 + n % 28:02d}T1{k}:20:00",
                        "measure_value": f"{n}.{k}5",
                        "measure_unit": "GB" if kind == "USAGE" else "MINUTES",
                        "source_updated_at": "2025-06-30T06:00:00",
                    }
                )
    return rows


def service_id(n: int, line: int = 1, series: int = 1) -> str:
    return f"line-{n:02d}{'' if series else 'x'}-{line}"


def service(n: int, line: int = 1, series: int = 1, **changes) -> dict:
    row = {
        "service_id": service_id(n, line, series),
        "customer_ssn": ssn(n) if series else ssn(n, 6),
        "service_type": ("FIBRE", "MOBILE")[line % 2],
        "installation_address_line1": f"Wall {n}",
        "installation_city": "Elsewhere",
        "installation_postal_code": f"{80000 + n}",
        "installation_country_code": "DE",
        "is_valid": "True",
        "valid_from": "2024-02-01",
        "valid_to": "2026-05-31",
        "source_updated_at": "2025-06-30T06:30:00",
    }
    row.update(changes)
    return row


def services() -> list[dict]:
    rows = [service(n) for n in WITH_FACTS] + [service(GONE, series=0)]
    return rows + [
        service(2, 2, is_valid="False"),
        service(3, 2, valid_from="2025-09-01", valid_to="2025-02-01"),
        service(4, 2, valid_from="2024-02-01", valid_to="2025-03-31"),
        service(4, 2, valid_from="2025-04-01", valid_to="2025-12-31"),
        service(5, 2),
        service(5, 2, valid_from="2025-05-01"),
        service(MASKED, 2, is_valid="False"),
    ]


def invoice(label: str, n: int, line: int = 1, series: int = 1, **changes) -> dict:
    row = {
        "invoice_id": f"bill-{label}",
        "customer_ssn": ssn(n) if series else ssn(n, 6),
        "service_id": service_id(n, line, series),
        "amount": f"{10 + n}.40",
        "currency_code": "EUR",
        "issued_date": "2025-06-05",
        "due_date": "2025-07-05",
        "is_paid": "False",
        "is_due": "False",
        "source_updated_at": "2025-06-30T07:00:00",
    }
    row.update(changes)
    return row


def invoices() -> list[dict]:
    rows = [invoice(f"{n}", n) for n in WITH_FACTS] + [invoice("gone-old", GONE, series=0)]
    paid = {"is_paid": "True", "paid_at": "2025-06-20"}
    rows += [invoice(f"{n}-paid", n, **paid) for n in (*RESIDENTS, MASKED)]
    return rows + [
        invoice("no-such-line", 1, service_id="line-99-1"),
        invoice("of-another", 1, service_id=service_id(2)),
        invoice("of-the-deleted", 1, service_id=service_id(GONE)),
        invoice("unusable", 2, 2),
        invoice("unusable-period", 3, 2),
        invoice("too-early", 6, issued_date="2023-12-31", due_date="2024-01-31"),
        invoice("first-version", 4, 2, issued_date="2025-03-31"),
        invoice("second-version", 4, 2, issued_date="2025-04-01"),
        invoice("two-versions", 5, 2),
        invoice("one-of-two", 5, 2, issued_date="2025-04-30"),
        invoice("backwards", 7, due_date="2025-06-04"),
        invoice("paid-never", 7, is_paid="True"),
        invoice("unpaid-but-when", 8, paid_at="2025-06-25"),
        invoice("paid-before", 8, is_paid="True", paid_at="2025-06-04"),
        invoice("long-overdue", MOVER, due_date="2025-06-06", is_due="True"),
        invoice("masked-unusable", MASKED, 2),
    ]


def as_extract(spark, name: str, rows: list[dict]):
    columns = EXTRACT_COLUMNS[name]
    return literal_relation(spark, [tuple(r.get(c) for c in columns) for r in rows], extract_schema(name))


def extracts(spark, **changed: list[dict]) -> dict:
    rows = {
        "customer": customers(),
        "customer_deletion_confirmations": decisions(),
        "customer_events": events(),
        "customer_services": services(),
        "invoices": invoices(),
    }
    rows.update(changed)
    return {name: as_extract(spark, name, value) for name, value in rows.items()}
