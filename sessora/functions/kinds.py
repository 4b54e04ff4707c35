"""Predicates on the event kind column ``type``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sessora import schemas as S


def is_start(kind: str = "type") -> Column:
    return F.col(kind) == S.SESSION_STARTED


def is_close(kind: str = "type") -> Column:
    return F.col(kind) == S.SESSION_CLOSED


def is_recv(kind: str = "type") -> Column:
    return F.col(kind) == S.RECV_COMPLETED


def is_send(kind: str = "type") -> Column:
    return F.col(kind) == S.SEND_COMPLETED


def is_message(kind: str = "type") -> Column:
    return F.col(kind) == S.PACKET_PARSED


def is_error(kind: str = "type") -> Column:
    return F.col(kind) == S.PROTOCOL_ERROR
