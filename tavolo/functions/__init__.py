from tavolo.functions.clock import ntz_from_micros, ntz_micros
from tavolo.functions.money import (DEFAULT_TAX_RATE, MONEY, RATE, as_report, js_round,
                                    line_amount, money, sum_money, tax_on)
from tavolo.functions.text import (ACTIVE_STATUSES, blank_to_null, digits_only,
                                   encode_uri_component, is_active, is_blank,
                                   strip_one_trailing_slash)

__all__ = ["ntz_from_micros", "ntz_micros", "DEFAULT_TAX_RATE", "MONEY", "RATE", "as_report", "js_round", "line_amount",
           "money", "sum_money", "tax_on", "ACTIVE_STATUSES", "blank_to_null", "digits_only",
           "encode_uri_component", "is_active", "is_blank", "strip_one_trailing_slash"]
