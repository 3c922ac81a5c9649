"""Text, format, JSON and timestamp expressions (all built-in, JVM-side) with SQL twins where used."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identity rules (first failing rule wins) and their messages.
USERNAME_MIN, USERNAME_MAX = 3, 30
USERNAME_CHARSET = r"^[A-Za-z0-9_.-]+$"
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
PASSWORD_MIN = 8
MESSAGES = {
    "username_short": "Username must contain at least 3 characters.",
    "username_long": "Username must not exceed 30 characters.",
    "username_charset": "Username may contain only letters, numbers, underscores, full stops and hyphens.",
    "email": "Enter a valid email address.",
    "password_short": "Password must contain at least 8 characters.",
    "password_upper": "Password must include at least one uppercase letter.",
    "password_lower": "Password must include at least one lowercase letter.",
    "password_digit": "Password must include at least one number.",
}
# Display-name truncation (longer than 24 characters -> first 22 + ellipsis).
NAME_MAX, NAME_KEEP, ELLIPSIS = 24, 22, "…"
NOT_AVAILABLE = "Not available"


def strip(c: Column) -> Column:
    """Without white space (of any kind, not blanks alone) at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


# The patterns of the next two functions.
def safe_file_name(c: Column) -> Column:
    """Runs of characters outside [A-Za-z0-9._-] become '_', then leading/trailing '_' are trimmed."""
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")


def slug(c: Column) -> Column:
    """lower case, spaces -> '_', parentheses removed."""
    return F.regexp_replace(F.replace(F.lower(c), F.lit(" "), F.lit("_")), r"[()]", "")


def display_name(c: Column) -> Column:
    """'_' -> ' ', then names longer than 24 characters keep 22 and get an ellipsis."""
    v = F.replace(c, F.lit("_"), F.lit(" "))
    return F.when(F.length(v) <= NAME_MAX, v).otherwise(F.concat(F.substring(v, 1, NAME_KEEP), F.lit(ELLIPSIS)))


def identity_error(username: Column, email: Column, password: Column | None = None) -> Column:
    """First failing identity rule's message after normalisation (username trimmed, email trimmed+lowered)."""
    u = strip(username)
    e = F.lower(strip(email))
    chain = (F.when(F.length(u) < USERNAME_MIN, F.lit(MESSAGES["username_short"]))
             .when(F.length(u) > USERNAME_MAX, F.lit(MESSAGES["username_long"]))
             .when(~u.rlike(USERNAME_CHARSET), F.lit(MESSAGES["username_charset"]))
             .when(~e.rlike(EMAIL_PATTERN), F.lit(MESSAGES["email"])))
    if password is not None:
        chain = (chain.when(F.length(password) < PASSWORD_MIN, F.lit(MESSAGES["password_short"]))
                 .when(~password.rlike("[A-Z]"), F.lit(MESSAGES["password_upper"]))
                 .when(~password.rlike("[a-z]"), F.lit(MESSAGES["password_lower"]))
                 .when(~password.rlike("[0-9]"), F.lit(MESSAGES["password_digit"])))
    return chain


def identity_error_sql(username: str, email: str, password: str | None = None) -> str:
    u, e = (f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')" for x in (username, email))
    e = f"lower({e})"
    parts = [
        f"when length({u}) < {USERNAME_MIN} then '{MESSAGES['username_short']}'",
        f"when length({u}) > {USERNAME_MAX} then '{MESSAGES['username_long']}'",
        f"when not regexp_matches({u}, '{USERNAME_CHARSET}') then '{MESSAGES['username_charset']}'",
        f"when not regexp_matches({e}, '{EMAIL_PATTERN}') then '{MESSAGES['email']}'",
    ]
    if password is not None:
        parts += [
            f"when length({password}) < {PASSWORD_MIN} then '{MESSAGES['password_short']}'",
            f"when not regexp_matches({password}, '[A-Z]') then '{MESSAGES['password_upper']}'",
            f"when not regexp_matches({password}, '[a-z]') then '{MESSAGES['password_lower']}'",
            f"when not regexp_matches({password}, '[0-9]') then '{MESSAGES['password_digit']}'",
        ]
    return "(case " + " ".join(parts) + " end)"


def format_number(c: Column, decimals: int = 4) -> Column:
    """Fixed-point text of a value that may be text; 'Not available' when it is not a number."""
    v = c.try_cast("double")
    return F.when(v.isNull(), F.lit(NOT_AVAILABLE)).otherwise(F.format_string(f"%.{decimals}f", v))


def iso_seconds(ts: Column) -> Column:
    """ISO-8601 text to whole seconds, e.g. 2024-01-01T00:00:07."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def report_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
