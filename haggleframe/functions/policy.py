"""Retry, deferral and state rules of the work queue as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from haggleframe.functions.text import has_text

MINUTE, HOUR = 60_000, 3_600_000


#: What a reason contains if waiting helps, and if it doesn't.
TRANSIENT = ("cooldown", "rallent", "richieste", "429", "403", "timeout", "tempor", "rete", "network")
MISS = (
    "abbastanza univoco", "nessun annuncio compatibile", "più annunci compatibili", "non corrispondono abbastanza", "non supera la verifica", "non disponibile (404)",
    "metadati dell’annuncio non sono leggibili", "metadati seller/foto non disponibili", "candidati equivalenti", "ambigu",
)


def reason_class(reason: Column) -> Column:
    """Transient failures wait for the next permit, deterministic misses settle soon, others back off."""
    low = F.lower(F.coalesce(reason, F.lit("")))
    return F.when(has_text(low, *TRANSIENT), "TRANSIENT").when(has_text(low, *MISS), "MISS").otherwise("OTHER")


def settles(kind: Column, attempt: Column) -> Column:
    return ((kind == "MISS") & (attempt >= 3)) | ((kind == "OTHER") & (attempt >= 6))


def retry_delay_ms(kind: Column, attempt: Column) -> Column:
    """2 minutes after a miss, doubling from 10 minutes up to 6 hours after other failures, none after transient ones."""
    backoff = F.least(F.lit(6 * HOUR).cast("long"), (10 * MINUTE * F.pow(F.lit(2), F.least(F.lit(5), attempt - 1))).cast("long"))
    return F.when(kind == "TRANSIENT", 0).when(kind == "MISS", 2 * MINUTE).otherwise(backoff).cast("long")


def next_state(kind: Column, attempt: Column, explicit: Column) -> Column:
    """A settled job of an explicit wish goes to review, one that the machine wanted is parked."""
    return F.when(~settles(kind, attempt), "FAILED_RETRYABLE").when(explicit, "NEEDS_REVIEW").otherwise("FAILED_PERMANENT")


#: Identity states in the order in which they may follow each other.
IDENTITY = ("PENDING_ANALYSIS", "REQUIRED", "REVIEW", "MATCHED")


def monotone(old: Column, new: Column) -> Column:
    """The later of two identity states: a stale result never takes one back."""
    order = F.create_map(*[F.lit(x) for i, s in enumerate(IDENTITY) for x in (s, i)])
    return F.when(F.coalesce(order[new], F.lit(-1)) > F.coalesce(order[old], F.lit(-1)), new).otherwise(old)
