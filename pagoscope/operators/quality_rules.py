"""Row quality rules (C1-C14) and their registry (K1).

A rule is an expression: the code text when a row breaks it, NULL when it passes.
Rules are ordered, and the order is kept in every text built from the codes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from pagoscope import fixed_values as fv
from pagoscope.functions import (
    is_blank, is_email, literal, literals, member, parse_number, parse_timestamp, strip,
    upper_strip,
)

CRITICAL, WARNING = "CRITICAL", "WARNING"

AS_OF = "_as_of"

# Parsed once per payment and shared by rules and findings: name -> SQL text.
HELPERS = {
    "_no_id": is_blank("payment_id"),
    "_no_name": is_blank("customer_name"),
    "_no_email": is_blank("customer_email"),
    "_no_amount": is_blank("amount"),
    "_no_currency": is_blank("currency_code"),
    "_no_status": is_blank("status"),
    "_no_country": is_blank("country_code"),
    "_no_created": is_blank("created_at"),
    "_no_updated": is_blank("updated_at"),
    "_no_source": is_blank("source_system"),
    "_number": parse_number("amount"),
    "_created": parse_timestamp("created_at"),
    "_updated": parse_timestamp("updated_at"),
    "_status": upper_strip("status"),
    "_currency": upper_strip("currency_code"),
    "_country": strip("country_code"),
    "_email": strip("customer_email"),
}


@dataclass(frozen=True)
class Rule:
    """One quality rule.

    ``code`` is SQL text over the payment columns, the ``HELPERS`` and
    ``_as_of`` (or a callable that returns a Column). ``families`` lists the
    code families the rule is expected to emit; ``None`` says the family itself
    depends on the data (one code per currency and country). Codes outside the
    list are counted under their own family, unless ``closed`` promises that
    there are none, which spares the check.
    """

    name: str
    level: str
    code: str | Callable[[], Column]
    families: tuple[str, ...] | None
    closed: bool = False

    @property
    def column(self) -> str:
        return f"_code_{self.name}"

    def expression(self) -> Column:
        return F.expr(self.code) if isinstance(self.code, str) else self.code()


def with_helpers(payments: DataFrame, as_of: Column) -> DataFrame:
    """Parse each text once; columns that nothing reads are pruned away."""
    parsed = {name: F.expr(text) for name, text in HELPERS.items()}
    return payments.withColumns({**parsed, AS_OF: as_of})


def _cases(*pairs: tuple[str, str]) -> str:
    """``CASE`` over (condition, code text expression), first match wins."""
    return "CASE " + " ".join(f"WHEN {when} THEN {code}" for when, code in pairs) + " END"


def _expected_pair() -> str:
    """The currency is one of those the country allows."""
    pairs = [
        f"(upper(_country) = {literal(country)}"
        f" AND coalesce(_currency, 'NAN') IN ({literals(allowed)}))"
        for country, allowed in fv.COUNTRY_CURRENCIES.items()
    ]
    return "(" + " OR ".join(pairs) + ")"


RULES: tuple[Rule, ...] = (
    Rule("payment_id", CRITICAL, _cases(("_no_id", "'payment_id_nulo'")),
         ("payment_id_nulo",)),
    Rule("amount_missing", CRITICAL, _cases(("_no_amount", "'amount_nulo'")),
         ("amount_nulo",)),
    Rule("amount_sign", CRITICAL,
         _cases(("amount IS NOT NULL AND _number IS NULL", "'amount_no_numerico'"),
                ("_number < 0", "'amount_negativo'")),
         ("amount_no_numerico", "amount_negativo")),
    # NaN sorts above every number in Spark, so it is excluded explicitly.
    Rule("amount_limit", CRITICAL,
         _cases((f"_number > {literal(fv.AMOUNT_LIMIT)} AND NOT isnan(_number)",
                 "'amount_supera_limite'")),
         ("amount_supera_limite",)),
    Rule("completed_without_amount", WARNING,
         _cases(("_status = 'COMPLETED' AND _no_amount", "'completado_sin_monto'")),
         ("completado_sin_monto",)),
    Rule("status", WARNING,
         _cases(("_no_status", "'status_nulo_legacy'"),
                ("_status = 'UNKNOWN'", "'status_unknown_legacy'"),
                (f"_status NOT IN ({literals(fv.STATUSES)})",
                 "concat('status_no_reconocido:', _status)")),
         ("status_nulo_legacy", "status_unknown_legacy", "status_no_reconocido")),
    Rule("currency", WARNING,
         _cases(("_no_currency", "'currency_nulo_legacy'"),
                (f"_currency IN ({literals(fv.CURRENCIES_WITHOUT_VALUE)})",
                 "'currency_sin_valor_iso'"),
                (f"_currency NOT IN ({literals(fv.CURRENCIES)})",
                 "concat('currency_no_habilitada:', _currency)")),
         ("currency_nulo_legacy", "currency_sin_valor_iso", "currency_no_habilitada")),
    Rule("country", WARNING,
         _cases(("_no_country", "'country_nulo'"),
                (f"upper(_country) NOT IN ({literals(fv.COUNTRIES)})",
                 "concat('country_desconocido:', _country)")),
         ("country_nulo", "country_desconocido")),
    Rule("email_missing", WARNING, _cases(("_no_email", "'customer_email_nulo'")),
         ("customer_email_nulo",)),
    Rule("email_shape", WARNING,
         _cases((f"NOT _no_email AND NOT {is_email('_email')}", "'email_formato_invalido'")),
         ("email_formato_invalido",)),
    Rule("created_at", WARNING,
         _cases(("_no_created", "'created_at_nulo'"),
                ("_created IS NULL", "'created_at_formato_invalido'"),
                (f"_created > {AS_OF}", "'created_at_futura'")),
         ("created_at_nulo", "created_at_formato_invalido", "created_at_futura")),
    Rule("updated_at", WARNING,
         _cases(("_updated < _created", "'updated_at_menor_que_created_at'")),
         ("updated_at_menor_que_created_at",)),
    # A null currency takes part as the text NAN; a blank one does not.
    Rule("country_currency", WARNING,
         _cases((f"{member('upper(_country)', fv.COUNTRY_CURRENCIES)}"
                 f" AND coalesce(_currency, 'NAN') NOT IN ('', 'USD')"
                 f" AND NOT {_expected_pair()}",
                 "concat('moneda_', coalesce(_currency, 'NAN'),"
                 " '_no_esperada_para_', upper(_country))")),
         None),
    Rule("source_system", WARNING, _cases(("_no_source", "'source_system_nulo'")),
         ("source_system_nulo",)),
)
# the codes of these rules are the literals above
RULES = tuple(replace(rule, closed=rule.families is not None) for rule in RULES)
RULES_BY_NAME = {rule.name: rule for rule in RULES}


def extend(rules: tuple[Rule, ...], *extra: Rule) -> tuple[Rule, ...]:
    """K1: the registry with user rules appended; names and families stay unique."""
    combined = tuple(rules) + extra
    names = [rule.name for rule in combined]
    families = [family for rule in combined for family in rule.families or ()]
    for what, values in (("rule name", names), ("code family", families)):
        repeated = sorted({v for v in values if values.count(v) > 1})
        if repeated:
            raise ValueError(f"duplicate {what}: {', '.join(repeated)}")
    return combined
