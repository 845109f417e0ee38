"""What a response or an error means for an item: status, error class, exit code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOCUMENT_CODES = (200, 204, 206, 304)
NO_DOCUMENT_CODES = (401, 403, 404, 405, 410)
REDIRECT_CODES, REPEAT_REDIRECT_CODES = (301, 302, 303, 307, 308), (307, 308)

#: Error classes from least to most severe with their exit codes. Authentication errors are server errors here, being
#: a subclass that is looked up after its parent.
EXIT_CODES = {"ServerError": 8, "ProtocolError": 7, "AuthenticationError": 6, "SSLVerificationError": 5, "NetworkError": 4, "OSError": 3, "ValueError": 2, "Exception": 1}
PARENTS = {
    "AuthenticationError": "ServerError", "ConnectionRefused": "NetworkError", "DNSNotFound": "NetworkError", "NetworkTimedOut": "NetworkError",
}


def status_of_code(code: Column, content_on_error: bool = False) -> Column:
    """done, skipped, redirect or error."""
    done = code.isin(*DOCUMENT_CODES)
    return F.when(done, "done").when(code.isin(*REDIRECT_CODES), "redirect").when(code.isin(*NO_DOCUMENT_CODES), "done" if content_on_error else "skipped").otherwise("done" if content_on_error else "error")


def status_of_error(error: Column, retry_connrefused: bool = False, retry_dns_error: bool = False) -> Column:
    """Refused connections and unknown hosts are skipped unless they are retried; other errors are errors."""
    gone = (F.lit(not retry_connrefused) & (error == "ConnectionRefused")) | (F.lit(not retry_dns_error) & (error == "DNSNotFound"))
    return F.when(error.isNull(), None).when(gone, "skipped").otherwise("error")


def error_class(error: Column) -> Column:
    """The class under which an error is counted."""
    out = error
    for name, parent in PARENTS.items():
        out = F.when(error == name, parent).otherwise(out)
    return F.when(error.isNull(), None).when(out.isin(*EXIT_CODES), out).otherwise("Exception")


def exit_code_of(error: Column) -> Column:
    kind = error_class(error)
    out = F.lit(0)
    for name, code in EXIT_CODES.items():
        out = F.when(kind == name, code).otherwise(out)
    return out


def count_errors(results: DataFrame, error_col: str = "error") -> DataFrame:
    return results.filter(F.col(error_col).isNotNull()).groupBy(error_class(F.col(error_col)).alias("error_class")).agg(F.count("*").alias("n"))


def exit_status(results: DataFrame, error_col: str = "error") -> DataFrame:
    """The least code of all errors, 0 without any."""
    return results.agg(F.coalesce(F.min(F.nullif(exit_code_of(F.col(error_col)), F.lit(0))), F.lit(0)).cast("int").alias("exit_code"))


def action_status(action: Column, status: Column) -> Column:
    """normal keeps the status, retry makes it an error, finish a done item; stop ends the crawl and keeps it."""
    return F.when(action == "retry", "error").when(action == "finish", "done").otherwise(status)
