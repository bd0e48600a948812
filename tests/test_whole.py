"""Queries do their whole job: fixtures that a subset, a prefix or a cap would show on."""

import hashlib
import json

import pandas as pd

from quillon.plans import catalogue


def folder(path, **tables) -> str:
    for name, rows in tables.items():
        pd.DataFrame(rows).to_parquet(path / f"{name}.parquet", coerce_timestamps="us")
    return str(path)


def test_json_minify_takes_every_event(spark, tmp_path):
    events = [{"event_id": k, "props": f'{{"k": {k}, "s": "a  b"}}'} for k in range(25)]
    got = {r.event_id: r.small for r in catalogue.QUERIES["json_minify"](spark, folder(tmp_path, events=events)).collect()}
    assert got == {e["event_id"]: json.dumps(json.loads(e["props"]), separators=(",", ":")) for e in events}


def test_log_timestamp_strip_reads_every_event(spark, tmp_path):
    events = [{"event_id": k, "event_type": "ab"[k % 2], "ts": pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=k)} for k in range(1980, 2040)]
    got = {r.event_type: r.stripped for r in catalogue.QUERIES["log_timestamp_strip"](spark, folder(tmp_path, events=events)).collect()}
    assert got == {t: hashlib.md5("\n".join(f"event {e['event_id']}" for e in events if e["event_type"] == t).encode()).hexdigest() for t in "ab"}


def test_base64_blocks_takes_whole_texts(spark, tmp_path):
    texts = ["short", "x" * 18, "näive text of some words " * 4, "a" * 299, "words behind the three hundredth character " * 200, "長い文 " * 30_000]
    got = {r.doc_id: r.decoded for r in catalogue.QUERIES["base64_blocks"](spark, folder(tmp_path, documents=[{"doc_id": k, "text": t} for k, t in enumerate(texts)])).collect()}
    assert got == {k: hashlib.md5(t.encode()).hexdigest() for k, t in enumerate(texts) if k}


def test_prompt_cache_model_keeps_whole_prompts(spark, tmp_path):
    day, start = pd.Timedelta(days=1), pd.Timestamp("2024-01-01")
    times = [start + k * day / 4 for k in range(50)] + [start + 20 * day, start + 40 * day]
    events = [{"event_id": k, "user_id": 7, "ts": t} for k, t in enumerate(times)]
    got = {r.id: (r.total, r.read) for r in catalogue.QUERIES["prompt_cache_model"](spark, folder(tmp_path, events=events)).collect()}
    warm = {k: (400 * (k + 1), 400 * k if k > 2 else 0) for k in range(50)}
    assert got == warm | {50: (400 * 51, 0), 51: (400, 0)}


def test_known_value_search_finds_marked_and_short_passages(spark, tmp_path):
    passages = ["one two three four five six", "alpha beta gamma", "alpha  beta gamma delta", "pair here", "lone", " lead word in", "five words in all here"]
    texts = ['he said "one two three four five six".', "(alpha beta gamma) again", "xalpha  beta gamma deltax", "a pair herein", "cyclone", "to lead word into", "none", "<five words in all here>", "one two three four five  six", ""]
    benchmark = [{"item_id": k, "text": t} for k, t in enumerate(passages)]
    documents = [{"doc_id": k, "text": t} for k, t in enumerate(texts)]
    got = sorted((r.item_id, r.doc_id) for r in catalogue.QUERIES["known_value_search"](spark, folder(tmp_path, benchmark=benchmark, documents=documents)).collect())
    assert got == [(i, d) for i, p in enumerate(passages) for d, t in enumerate(texts) if p in t]


def test_infrastructure_hosts_has_no_cap_on_a_source(spark, tmp_path):
    supplier = [{"s_suppkey": k, "s_name": f"Supplier#{k:09d}", "s_nationkey": k % 2} for k in range(1_400)]
    got = sorted(tuple(r) for r in catalogue.QUERIES["infrastructure_hosts"](spark, folder(tmp_path, supplier=supplier)).collect())
    assert got == sorted((f"n{k % 2}", "host", f"supplier-{k:09d}{end}") for k in range(1_400) for end in ("", ".corp"))


def test_ipv6_addresses_of_numbers_beyond_a_group(spark, tmp_path):
    keys = [0, 1, 0xFFFF, 0x10000, 0x10001, 900_000, 0x1234_0000, 0xABCDE_0F00F, 0x7FFF_0000_0000_FFFF]
    customer = [{"c_custkey": k, "c_nationkey": n % 25} for n, k in enumerate(keys)]
    got = {r.c_custkey: (r.groups, r.reserved, r.is_private) for r in catalogue.QUERIES["ipv6_addresses"](spark, folder(tmp_path, customer=customer)).collect()}
    assert got == {k: (f"2a02:8070:{k:x}:0:0:0:0:{n % 25 + 1:x}", False, True) for n, k in enumerate(keys)}
