"""Conversations by hand: inherited filters, session pages, prompt texts."""

from __future__ import annotations

from lodestone.operators import conversation

SCHEMA = """session_id int, seq int, role string, content string, created_at timestamp, route string, country string, author_name string, institution_name string, topic_name string,
    keyword string, document_type string, year_from int, year_to int, sources array<struct<publication_id: string, doi: string, title: string>>"""


def messages(spark, rows):
    from datetime import datetime

    full = []
    for session, seq, role, content, more in rows:
        full.append((session, seq, role, content, datetime(2024, 1, 1, 0, seq), more.get("route"), *(more.get(k) for k in conversation.SCOPE_KEYS), more.get("sources")))
    return spark.createDataFrame(full, SCHEMA)


def test_all_eight_filters_are_inherited(spark):
    first = {"country": "ID", "author_name": "A", "institution_name": "U", "topic_name": "T", "keyword": "K", "document_type": "Article", "year_from": 2001, "year_to": 2009}
    m = messages(spark, [(1, 0, "user", "q", first), (1, 1, "user", "r", {"country": "MY", "keyword": "", "year_to": 2010}), (1, 2, "user", "s", {})])
    rows = {r.seq: r for r in conversation.effective_filters(conversation.scope(m)).collect()}
    assert rows[0].inherited == []
    assert rows[1].inherited == ["author_name", "institution_name", "topic_name", "keyword", "document_type", "year_from"]  # an empty text is not set
    assert (rows[1].effective_country, rows[1].effective_keyword, rows[1].effective_year_to) == ("MY", "K", 2010)
    assert rows[2].inherited == conversation.SCOPE_KEYS and (rows[2].effective_country, rows[2].effective_year_from, rows[2].effective_year_to) == ("MY", 2001, 2010)
    last = conversation.last_scope(m).first()
    assert (last.country, last.keyword, last.year_from, last.year_to, last.messages_covered) == ("MY", "K", 2001, 2010, 3)


def test_session_pages_count_sources_once_and_hide_archived(spark):
    a = [("p1", "d", "t"), (None, "d", "t"), (None, None, "t"), (None, None, None)]
    m = messages(spark, [(1, 0, "user", "hello", {"route": "graph"}), (1, 1, "assistant", "x", {"route": "sql", "sources": a}), (1, 2, "assistant", "y", {"sources": a}), (2, 0, "user", "two", {}), (3, 0, "user", "three", {"sources": []})])
    about = spark.createDataFrame([(2, "archived"), (3, "active")], "session_id int, status string")
    got = {r.session_id: (r.message_count, r.source_count, r.last_route, r.title) for r in conversation.sessions(m, 10, about).collect()}
    assert got == {1: (3, 3, "sql", "hello"), 3: (1, 0, None, "three")}  # a source without any identity is none; one not named is active
    assert [r.session_id for r in conversation.sessions(m, 10, about, "archived").collect()] == [2]
    assert [r.session_id for r in conversation.sessions(m, 1).collect()] == [1]


def test_context_leaves_out_what_has_nothing_to_say(spark):
    m = messages(spark, [(1, 0, "user", "old", {"country": "ID", "year_from": 2020}), (1, 1, "assistant", "an  answer", {}), (1, 2, "user", "x" * 300, {}), (2, 0, "assistant", None, {})])
    stored = spark.createDataFrame([(1, " S "), (2, "  ")], "session_id int, summary string")
    got = {r.session_id: r.context for r in conversation.context(m, stored, n=2).collect()}
    assert got[1] == "[Ringkasan percakapan]\nS\n\n[Cakupan sesi]\nNegara=ID; Tahun mulai=2020\n\n[Percakapan sebelumnya]\nAsisten (jawaban sebelumnya, BUKAN bukti): an answer\nPengguna: " + "x" * 199 + "…"
    assert got[2] == "[Percakapan sebelumnya]\nAsisten (jawaban sebelumnya, BUKAN bukti): "
    assert "[Ringkasan" not in conversation.context(m).filter("session_id = 1").first().context
    assert conversation.context(m.filter("false")).collect() == []
