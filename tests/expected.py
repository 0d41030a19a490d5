"""What a build over the fixture population must give, worked out row by row in plain Python."""

from __future__ import annotations

import fixture_rows as fx

ERASED = "-99999"


class Expected:
    def __init__(self, cutoff: str = "9999-12-31 00:00:00", customers: list[dict] | None = None):
        self.customers = customers or fx.customers()
        self.requests = {r["customer_change_id"]: r for r in self.customers if r["source_operation"] == "DELETE"}
        known = [d for d in fx.decisions() if d["recorded_at"].replace("T", " ") <= cutoff]
        self.authorized = [d for d in known if self._status(d) == "AUTHORIZED"]
        self.status = {r: "PENDING" for r in self.requests}
        for d in sorted(known, key=lambda d: d["recorded_at"]):
            self.status[d["deletion_request_id"]] = self._status(d)
        #: number -> modes in the order they were recorded
        self.modes: dict[str, list[str]] = {}
        self.plan_rows = 0
        for d in sorted(self.authorized, key=lambda d: d["recorded_at"]):
            for number in self._numbers(self.requests[d["deletion_request_id"]]["customer_id"]):
                self.modes.setdefault(number, []).append(d["deletion_mode"])
                self.plan_rows += 1
        self.ledger = {n: fx.FULL if fx.FULL in m else fx.SPECIAL for n, m in self.modes.items()}
        latest: dict[str, dict] = {}
        for r in self.customers:
            old = latest.get(r["customer_id"])
            if r["source_operation"] == "UPSERT" and (old is None or r["source_updated_at"] > old["source_updated_at"]):
                latest[r["customer_id"]] = r
        self.map = {
            r["customer_ssn"]: r for r in latest.values() if r["is_active"] == "True" and r["customer_ssn"] not in self.ledger
        }
        self.services = {(s["service_id"], s["valid_from"]): self._service(s) for s in fx.services()}
        self.events = {e["event_id"]: self._event(e) for e in fx.events()}
        self.invoices = {i["invoice_id"]: self._invoice(i) for i in fx.invoices()}

    @staticmethod
    def _status(d: dict) -> str:
        if d["legal_hold"] == "True":
            return "HELD"
        return {"CONFIRMED": "AUTHORIZED"}.get(d["decision_status"], d["decision_status"])

    def _numbers(self, customer: str) -> set[str]:
        return {r["customer_ssn"] for r in self.customers if r["customer_id"] == customer}

    @staticmethod
    def _usable(s: dict) -> bool:
        return s["is_valid"] == "True" and s["valid_from"] <= s["valid_to"]

    def _service(self, s: dict) -> str:
        if s["customer_ssn"] in self.ledger:
            return "DELETED"
        if s["customer_ssn"] not in self.map:
            return "CUSTOMER_NOT_FOUND"
        if s["is_valid"] != "True":
            return "INVALID_VALIDITY_FLAG"
        return "ACCEPTED" if self._usable(s) else "INVALID_VALIDITY_PERIOD"

    def _event(self, e: dict) -> str:
        mode = self.ledger.get(e["customer_ssn"])
        if mode:
            return "GONE" if mode == fx.FULL else "ERASED"
        return "ACCEPTED" if e["customer_ssn"] in self.map else "CUSTOMER_NOT_FOUND"

    def _invoice(self, i: dict) -> str:
        mode = self.ledger.get(i["customer_ssn"])
        if mode == fx.FULL:
            return "GONE"
        reason = self._reason(i, mode)
        if mode == fx.SPECIAL:
            return "ERASED" if reason == "ACCEPTED" else "SUPPRESSED"
        return reason

    def _reason(self, i: dict, mode: str | None) -> str:
        if mode is None and i["customer_ssn"] not in self.map:
            return "CUSTOMER_NOT_FOUND"
        rows = [s for s in fx.services() if s["service_id"] == i["service_id"] and (mode or s["customer_ssn"] not in self.ledger)]
        if not rows:
            return "SERVICE_NOT_FOUND"
        rows = [s for s in rows if s["customer_ssn"] == i["customer_ssn"]]
        if not rows:
            return "CUSTOMER_SERVICE_MISMATCH"
        rows = [s for s in rows if self._usable(s)]
        if not rows:
            return "SERVICE_INVALID"
        rows = [s for s in rows if s["valid_from"] <= i["issued_date"] <= s["valid_to"]]
        if len(rows) != 1:
            return "SERVICE_VERSION_AMBIGUOUS" if rows else "SERVICE_NOT_VALID_ON_ISSUE_DATE"
        if i["due_date"] < i["issued_date"]:
            return "INVALID_INVOICE_DATE_RANGE"
        paid, when = i["is_paid"] == "True", i.get("paid_at")
        if paid and not when:
            return "PAYMENT_DATE_MISSING"
        if not paid and when:
            return "PAYMENT_DATE_UNEXPECTED"
        return "PAYMENT_BEFORE_ISSUE_DATE" if when and when < i["issued_date"] else "ACCEPTED"

    @staticmethod
    def kept(outcomes: dict) -> list:
        return [k for k, v in outcomes.items() if v in ("ACCEPTED", "ERASED")]

    @staticmethod
    def rejects(outcomes: dict) -> dict:
        return {k: v for k, v in outcomes.items() if v not in ("ACCEPTED", "ERASED", "GONE", "DELETED", "SUPPRESSED")}

    def case_counts(self) -> dict[str, int]:
        def plain(outcomes: dict) -> int:
            return sum(v == "ACCEPTED" for v in outcomes.values())

        return {
            "case_dim_customer": len(self.map),
            "case_dim_service": plain(self.services),
            "case_fct_customer_event": plain(self.events),
            "case_fct_invoice": plain(self.invoices),
        }

    def counts(self) -> dict[str, int]:
        events, invoices = len(self.kept(self.events)), len(self.kept(self.invoices))
        services = len(self.kept(self.services))
        return {
            "fa_pd_customer": len(self.map),
            "fa_pd_service_address": services,
            "int_customer_protected": len(self.map),
            "int_customer_events_resolved": events,
            "int_customer_services_resolved": services,
            "int_invoices_resolved": invoices,
            "quarantine_customer_events": len(self.rejects(self.events)),
            "quarantine_customer_services": len(self.rejects(self.services)),
            "quarantine_invoices": len(self.rejects(self.invoices)),
            "dim_customer": len(self.map) + 1,
            "dim_service": services + 1,
            "dim_date": 1461,
            "fct_customer_event": events,
            "fct_invoice": invoices,
        }
