"""Operators on documents, commands, learned values, streams and settings: literal cases and brute force."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import compaction, conversations, documents, guards, hidden, learned, records, rules, scan, settings, shell, spans, standins
from quillon.sources import wire
from quillon.streaming import rewriters

LINES = "doc_id long, text string"


def one(spark, column, *values, kind="v string"):
    rows = spark.createDataFrame([(v,) for v in values], kind)
    return [r[0] for r in rows.select(column(F.col("v"))).collect()]


# spans


def places(text, value):
    return [k for k in range(len(text) - len(value) + 1) if text[k : k + len(value)] == value]


def test_every_place_of_a_value_against_brute_force(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("ab.\\E$é") for _ in range(rng.randrange(0, 30))), "".join(rng.choice("ab.\\E$é") for _ in range(rng.randrange(1, 4)))) for _ in range(200)] + [("aaaa", "aa"), ("", "a"), (None, "a"), ("a", None), ("a", "")]
    found = spark.createDataFrame(rows, "t string, v string").select("t", "v", spans.starts_of(F.col("t"), F.col("v")).alias("at")).collect()
    for r in found:
        if r.t is not None and r.v:
            assert r["at"] == places(r.t, r.v), r
        elif r.t is not None:
            assert not r["at"]


def test_propagation_masks_overlapping_and_short_copies(spark):
    docs = spark.createDataFrame([(1, "key abab and ababab, pin abc abc"), (2, "id 7 and x7y 7"), (3, None)], LINES)
    found = spark.createDataFrame([(1, "r", "secret", 4, 8, "abab"), (1, "s", "secret", 25, 28, "abc"), (2, "p", "pii", 3, 4, "7")], "doc_id long, rule_id string, category string, start int, end int, value string")
    masked = spans.propagated(found, docs)
    assert sorted((r.doc_id, r.start) for r in masked.collect()) == [(1, 4), (1, 13), (1, 15), (1, 25), (1, 29), (2, 3)]
    reps = spans.representatives(masked)
    out = {r.doc_id: r.text for r in spans.render(docs, reps.select("doc_id", "start", "end", F.lit("*").alias("replacement"))).collect()}
    assert out == {1: "key * and *, pin * *", 2: "id * and x7y 7", 3: None}


def test_numbers_and_strings_of_documents_propagate_by_kind(spark):
    docs = spark.createDataFrame([(1, 'n 4711000 "a\\"b" a"b')], LINES)
    found = spark.createDataFrame([(1, "structured-pii-field", "pii", 0, 1, "4711000", "number"), (1, "structured-secret-field", "secret", 0, 1, '"a\\"b"', "string")], "doc_id long, rule_id string, category string, start int, end int, value string, json_kind string")
    got = {(r.start, r.value) for r in spans.propagated(found, docs).collect()}
    assert got == {(0, "4711000"), (0, '"a\\"b"'), (10, '"a\\"b"'), (11, 'a\\"b'), (17, 'a"b')}


def test_context_scores(spark):
    rule = rules.Rule("r", "pii", "[0-9]{5}", context=("zip",), required=False)
    docs = spark.createDataFrame([(1, "zip 12345"), (2, "see 12345")], LINES)
    assert {r.doc_id: r.score for r in scan.scan(docs, [rule]).collect()} == {1: 1.0, 2: 0.4}
    assert {r.score for r in scan.scan(docs, [rules.Rule("r", "pii", "[0-9]{5}")]).collect()} == {1.0}


# shell


@pytest.mark.parametrize(
    ("command", "argvs", "only_reads"),
    [
        ("ls\nrm x", [["ls"], ["rm", "x"]], False), ("cat a | sed -Ei s/a/b/ x", [["cat", "a"], ["sed", "-Ei", "s/a/b/", "x"]], False), ("find . -fprintf out %p", [["find", ".", "-fprintf", "out", "%p"]], False),
        ("awk 'BEGIN{system(\"x\")}'", [["awk", 'BEGIN{system("x")}']], False), ("echo `rm x`", [["echo", ""], ["rm", "x"]], False), ('cat "c $(rm y) d" > /dev/null', [["cat", "c  d", ">/dev/null"], ["rm", "y"]], False),
        ("cat <<EOF\nrm -rf /\nEOF\nls", [["cat", "<<EOF"], ["ls"]], True), ("git diff --output=x", [["git", "diff", "--output=x"]], False), ("git log -3", [["git", "log", "-3"]], True), ("grep -c '; x' f 2>&1", [["grep", "-c", "; x", "f", "2>&1"]], True),
        ("sort -o f g", [["sort", "-o", "f", "g"]], False), ("date -s now", [["date", "-s", "now"]], False), ("X=1 ls -l # rm", [["X=1", "ls", "-l"]], True), ("ls >out", [["ls", ">out"]], False), ("", [], True), (None, [], True), ("(cd a && ls)", [["cd", "a"], ["ls"]], False),
        ("sed -n 'w out' f", [["sed", "-n", "w out", "f"]], False), ("find . -fls x", [["find", ".", "-fls", "x"]], False), ("echo 'unclosed", [["echo", "unclosed"]], True),
    ],
)
def test_programs_and_what_they_change(command, argvs, only_reads):
    assert shell.programs(command) == argvs
    assert all(map(shell.reads_only, argvs)) == only_reads


def test_heredocs_data_and_paths():
    assert shell.heredocs("cat <<A <<'B'\none\nA\ntwo\nB\nls") == [(14, 18), (20, 24)]
    assert shell.heredocs("cat <<< word\nls") == [] and shell.heredocs("cat <<X") == []
    assert shell.without_data("grep -r 'id_rsa' src | jq '.key' f && git commit -m \"x .env\"") == "grep -r          src | jq        f && git commit -m         "
    assert shell.path_candidates("cat {a,b}/.env $HOME/.netrc $'\\x2eenv' >out") == ["cat", "a/.env", "b/.env", "~/.netrc", ".env", "out"]
    assert shell.names_secret("x/*.pem") and shell.names_secret(".en?") and not shell.names_secret("*.py")


# documents


def test_scalars_with_places():
    text = ' {"a": [1, "x\\"y", null], "Pass-Word": "p", "b": {"c": -2.5e3}, "e": ""}'
    status, found = documents.scalars_of(text)
    assert status == "json"
    assert [(p, k, kind, v) for p, k, kind, _, _, v in found] == [("a[0]", None, "number", "1"), ("a[1]", None, "string", 'x"y'), ("Pass-Word", "Pass-Word", "string", "p"), ("b.c", "c", "number", "-2.5e3"), ("e", "e", "string", "")]
    assert all(json.loads(text[s:e]) == (v if kind == "string" else json.loads(v)) for _, _, kind, s, e, v in found)
    assert documents.label_category("Pass-Word") == "secret" and documents.label_category("x") is None
    assert [documents.scalars_of(t)[0] for t in (None, "", "plain", "{bad", "[" + "1," * 40_000 + "1]")] == ["text", "text", "text", "malformed", "incomplete"]


def test_redacted_values_keep_what_a_protocol_needs(spark):
    card = "4539148803436467"
    body = json.dumps({"model": "m", "messages": [{"role": "user", "content": f"pay {card}"}], "n": int(card), "encrypted_content": card, "password": "hunter22x", "ok": True, "s": "7"})
    rows = spark.createDataFrame([(1, body), (2, f"plain {card}"), (3, None), (4, "{" + f'"a": "{card}"')], "doc_id long, body string")
    got = {r.doc_id: r.body for r in documents.redacted_values(rows, [r for r in rules.DEFAULT_RULES if r.id == "pii-credit-card"]).collect()}
    out = json.loads(got[1])
    assert out["model"] == "m" and out["messages"][0]["role"] == "user" and out["encrypted_content"] == card and out["ok"] is True and out["s"] == "7"
    assert card not in out["messages"][0]["content"] and out["messages"][0]["content"].startswith("pay ")
    assert str(out["n"]) != card and out["password"] != "hunter22x"
    assert card not in got[2] and card not in got[4] and got[3] is None


def brute_crush(items):
    n, keep = len(items), set(range(3)) | set(range(len(items) - 2, len(items)))
    rare = set()
    for key in {k for i in items for k in i}:
        named = [json.dumps(i[key]) if key in i else "absent" for i in items]
        counts = {v: named.count(v) for v in named}
        if 2 <= len(counts) <= n / 2:
            few = [k for k, v in enumerate(named) if counts[v] <= max(1, n // 10)]
            rare |= set(few) if len(few) <= n / 2 else set()
        numbers = [i[key] for i in items if isinstance(i.get(key), (int, float))]
        if len(numbers) >= 10:
            mean = sum(numbers) / len(numbers)
            sigma = (sum((x - mean) ** 2 for x in numbers) / len(numbers)) ** 0.5
            rare |= {k for k, i in enumerate(items) if sigma and isinstance(i.get(key), (int, float)) and abs(i[key] - mean) > 3 * sigma}
    return keep | set(sorted(rare - keep)[:20])


def test_crushed_json_against_brute_force():
    rng = random.Random(5)
    for _ in range(20):
        items = [{"id": k, "state": rng.choice(["ok"] * 30 + ["bad"]), "size": rng.choice([5, 6, 7] * 20 + [900])} for k in range(rng.randrange(25, 90))]
        out = json.loads(documents.crushed_json(json.dumps({"rows": items})))["rows"]
        if len(items) < 30:
            assert out == items
            continue
        assert [x["id"] for x in out if isinstance(x, dict)] == sorted(brute_crush(items))
        assert sum(int(x[1:].split()[0]) for x in out if isinstance(x, str)) == len(items) - len(brute_crush(items))
    assert documents.crushed_json("no json") == "no json" and documents.crushed_json(None) is None and documents.crushed_json("[1, 2]") == "[1, 2]"


def longest_cut(head):
    """Every cut from the end on, closed by the brackets that are open there, in a string or not."""
    for cut in range(len(head), 0, -1):
        plain = re.sub(r'"(?:[^"\\]|\\.)*(?:"|$)', "", head[:cut])
        closing = ""
        for c in plain:
            closing = {"{": "}", "[": "]"}[c] + closing if c in "{[" else closing[1:] if c in "]}" else closing
        for end in (closing, '"' + closing):
            try:
                json.loads(head[:cut] + end)
            except ValueError:
                continue
            return head[:cut] + end


def test_clamped_json_is_the_longest_that_parses():
    rng = random.Random(6)
    for _ in range(60):
        text = json.dumps([{"role": "user", "text": "".join(rng.choice('ab"\\ {[,') for _ in range(rng.randrange(12))), "n": [1, {"x": None}]} for _ in range(3)])
        limit = rng.randrange(2, len(text) + 3)
        got = records.clamped(text, limit)
        if limit >= len(text):
            assert got == text
            continue
        assert json.loads(got) == json.loads(longest_cut(text[:limit]))
    assert records.clamped("plain text", 5) == "plain" and records.clamped(None, 5) is None


def test_spread_against_a_loop(spark):
    rng = random.Random(7)
    rows = [(k % 3, k, rng.randrange(100)) for k in range(60)]
    got = records.spread_batches(spark.createDataFrame(rows, "key long, n long, size long"), "key", "n", 4).collect()
    for key in range(3):
        loads = [0] * 4
        for _, n, size in sorted((r for r in rows if r[0] == key), key=lambda r: (-r[2], r[1])):
            at = loads.index(min(loads))
            assert [r.batch for r in got if r.key == key and r.n == n] == [at]
            loads[at] += size


# compaction and hidden text


def test_lines_collapse_and_all_passes_run(spark):
    bars = "\n".join(f"loading {k}% of 9 MB" for k in range(12))
    docs = spark.createDataFrame([(1, "a\n" + "x\n" * 12 + "b\n\n\n\n\nc"), (2, "start\n" + bars + "\nend"), (3, "p\nq"), (4, None), (5, "5%\n6%")], LINES)
    got = {r.doc_id: (r.text, r.n_collapsed) for r in compaction.collapse_repeated_lines(docs).collect()}
    assert got == {1: ("a\nx\n[11 more identical lines]\nb\n\nc", 2), 2: ("start\nloading 0% of 9 MB\n[10 similar progress lines]\nloading 11% of 9 MB\nend", 1), 3: ("p\nq", 0), 4: (None, 0), 5: ("5%\n6%", 0)}
    long = "\x1b[2K" + "same line of a log\n" * 200 + "ab01-_XY" * 300 + "=="
    out = {r.doc_id: r.text for r in compaction.compact(spark.createDataFrame([(1, long), (2, "\x1b[2Kshort")], LINES)).collect()}
    assert out == {1: "same line of a log\n[199 more identical lines]\n[encoded blob, 2402 chars, starting ab01-_XYab01]", 2: "\x1b[2Kshort"}


def test_mail_domains_and_stand_ins(spark):
    assert one(spark, wire.mail_domain, "a@Mail.Corp.COM.", "a@x.co.uk", "a@t-online.de", "a@example.net", "a@users.noreply.github.com", "no address", "a@localhost", None) == ["corp.com", "x.co.uk", None, None, None, None, None, None]
    made = one(spark, lambda v: standins.stand_in(F.lit("ipv6"), v), "2a02:8070:1:2::1", "2a02:8070:1:2::9", "no address")
    assert made[0].startswith("2001:db8:") and made[0] != made[1] and made[0].split(":")[:4] == made[1].split(":")[:4]


# learned values


def test_values_are_found_again_without_being_kept(spark):
    values = spark.createDataFrame([("Anna-Lena Berg", "r", 3), ("acme7", "s", 1), ("12345", "t", 1), ("word", "u", 1)], "value string, rule_id string, since long")
    kept = learned.remembered(values, b"k")
    assert kept.count() == 2 and "Anna" not in str(kept.collect())
    texts = spark.createDataFrame([(1, "ask anna-lena berg, ACME7 or acme70", 2), (2, None, 9), (3, "", 9)], "doc_id long, text string, seen long")
    assert sorted((r.start, r.value, r.since) for r in learned.find(texts, kept, b"k").collect()) == [(4, "anna-lena berg", 3), (20, "ACME7", 1)]
    assert [(r.start, r.value) for r in learned.swapped_findings(texts, values).collect()] == [(20, "ACME7")]
    assert learned.find(texts, kept, b"other key").count() == 0
    assert learned.find(texts.limit(0), kept, b"k").count() == 0


def test_swap_back_escapes_values_and_stops_at_the_network(spark):
    pairs = spark.createDataFrame([("si-1", 'a "b"\\c'), ("si-2", "x"), ("si-2", "y")], "stand_in string, value string")
    calls = spark.createDataFrame([(1, "Bash", '{"command":"echo si-1 si-2"}', None), (2, "WebFetch", '{"url":"http://h/ si-1"}', []), (3, "WebFetch", '{"url":"http://h/ si-1"}', ["pii"])], "call_id long, tool string, arguments string, allow_tags array<string>")
    got = {r.call_id: r for r in learned.plan_swap_back(calls, pairs).collect()}
    assert json.loads(got[1].arguments)["command"] == 'echo a "b"\\c si-2' and got[1].resolved == ["si-1"] and got[1].unresolved == ["si-2"]
    assert got[2].egress == ["si-1"] and "si-1" in got[2].arguments
    assert json.loads(got[3].arguments)["url"] == 'http://h/ a "b"\\c'


# streams


def deltas(style, text, arguments, size):
    cut = lambda s: [s[k : k + size] for k in range(0, len(s), size)]
    if style == "anthropic":
        return [{"type": "content_block_start", "index": 0, "content_block": {"type": "text", "text": ""}}, *({"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": x}} for x in cut(text)), {"type": "content_block_stop", "index": 0}, {"type": "content_block_start", "index": 1, "content_block": {"type": "tool_use", "name": "f", "input": {}}}, *({"type": "content_block_delta", "index": 1, "delta": {"type": "input_json_delta", "partial_json": x}} for x in cut(arguments)), {"type": "content_block_stop", "index": 1}]
    if style == "chat":
        return [*({"id": "c", "choices": [{"index": 0, "delta": {"content": x}}]} for x in cut(text)), *({"id": "c", "choices": [{"index": 0, "delta": {"tool_calls": [{"index": 0, "function": {"arguments": x}}]}}]} for x in cut(arguments)), {"id": "c", "choices": [{"index": 0, "delta": {}, "finish_reason": "stop"}]}]
    if style == "responses":
        return [*({"type": "response.output_text.delta", "item_id": "m", "content_index": 0, "delta": x} for x in cut(text)), {"type": "response.output_text.done", "item_id": "m", "text": text}, *({"type": "response.function_call_arguments.delta", "item_id": "f", "delta": x} for x in cut(arguments)), {"type": "response.function_call_arguments.done", "item_id": "f", "arguments": arguments}]
    return [*({"candidates": [{"content": {"parts": [{"text": x}]}}]} for x in cut(text)), {"candidates": [{"content": {"parts": [{"functionCall": {"args": json.loads(arguments)}}]}, "finishReason": "STOP"}]}]


def read(style, events):
    texts, calls = [], []
    for _, data in events:
        d = json.loads(data)
        if style == "anthropic":
            texts.append(d.get("delta", {}).get("text", ""))
            calls.append(d.get("delta", {}).get("partial_json", ""))
        elif style == "chat":
            for c in d["choices"]:
                texts.append(c["delta"].get("content") or "")
                calls += [t["function"]["arguments"] for t in c["delta"].get("tool_calls", [])]
        elif style == "responses":
            texts.append(d["delta"] if d["type"] == "response.output_text.delta" else "")
            calls.append(d["delta"] if d["type"].endswith("arguments.delta") else "")
        else:
            for p in d["candidates"][0]["content"]["parts"]:
                texts.append(p.get("text", ""))
                calls.append(json.dumps(p["functionCall"]["args"], separators=(",", ":")) if "functionCall" in p else "")
    return texts, [c for c in calls if c]


@pytest.mark.parametrize("style", rewriters.FORMATS)
def test_held_streams_cut_no_word_whatever_the_pieces(style):
    text, arguments = "Ask host-7.example now,\nthen " + "x" * 700 + " and\tstop", '{"cmd":"ping host-7"}'
    for size in (1, 3, 50, 2000):
        rewriter, out = rewriters.Rewriter(style), []
        for d in deltas(style, text, arguments, size):
            out += rewriter.push(None, json.dumps(d))
            rewriter = rewriters.Rewriter(style, rewriter.state())  # as between micro-batches
        out += rewriter.flush()
        texts, calls = read(style, out)
        assert "".join(texts) == text and calls == [arguments]
        assert not any("host" in t and "host-7.example " not in t for t in texts)
    with pytest.raises(ValueError):
        rewriters.Rewriter("other")


@pytest.mark.parametrize("style", rewriters.FORMATS)
def test_a_cut_stream_still_says_all(style):
    rewriter, out = rewriters.Rewriter(style), []
    for d in deltas(style, "one two", '{"a":1}', 2)[:-1]:
        out += rewriter.push(None, json.dumps(d))
    texts, calls = read(style, out + rewriter.flush())
    assert "".join(texts) == "one two" and (calls == ['{"a":1}'] or style == "gemini")
    assert rewriter.push(None, "no json") == [(None, "no json")]


def test_streams_over_several_micro_batches_equal_the_batch(spark, tmp_path):
    rows = []
    for k, style in enumerate(rewriters.FORMATS * 2):
        events = deltas(style, f"reply {k} says host-{k} twice: host-{k}", f'{{"n":{k}}}', 4)
        rows += [(f"r{k}", n, style, None, json.dumps(d), n == len(events) - 1) for n, d in enumerate(events)]
    table = spark.createDataFrame(rows, "reply string, seq long, style string, event string, data string, done boolean")
    for part in range(3):  # files by time, so state crosses micro-batches
        table.where(f"cast(seq / 6 as int) = {part}" if part < 2 else "seq >= 12").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = rewriters.hold_events(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    from_stream, batch = spark.read.parquet(f"{tmp_path}/out"), rewriters.hold_events(table)
    pairs = spark.createDataFrame([(f"host-{k}", f'real "{k}"') for k in range(8)], "stand_in string, value string")
    for k, style in enumerate(rewriters.FORMATS * 2):
        for held in (from_stream, batch):
            mine = sorted((r.seq, r.part, r.data) for r in rewriters.swapped_events(held, pairs).where(F.col("reply") == f"r{k}").collect())
            texts, calls = read(style, [(None, d) for _, _, d in mine])
            assert "".join(texts) == f'reply {k} says real "{k}" twice: real "{k}"' and calls == [f'{{"n":{k}}}']


# settings and small predicates


def test_settings_have_defaults_and_checks(spark, tmp_path):
    assert settings.read_config(spark, f"{tmp_path}/none.json") is None
    (tmp_path / "bad.json").write_text("[1]")
    assert settings.read_config(spark, f"{tmp_path}/bad.json") is None
    assert settings.user_settings(None) == settings.Settings()
    assert settings.watch_policy({"watch": {"terms": ["ab", " Abc ", "abc", 7], "action": "x"}}) == (("Abc",), "flag", False)
    assert settings.read_prices({"read_prices": {"a*": 0.5, "b": 2, "c": True, "d": "x"}}) == {"a*": 0.5}
    with pytest.raises(ValueError):
        settings.guard_policy({"guards": {"deny": ["not a ( selector"]}})
    with pytest.raises(ValueError):
        settings.user_settings({"rules": [{"id": "x", "category": "pii", "pattern": "a", "validator": "no such"}]})
    with pytest.raises(ValueError):
        settings.guard_script("perhaps Bash")


def test_originals_keep_the_newest_within_limits(spark):
    outputs = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "aa"), (4, None), (5, "c" * 10)], "id long, text string")
    assert {r.text for r in settings.originals(outputs, most=2).collect()} == {"aa", "c" * 10}
    assert {r.text for r in settings.originals(outputs, most_chars=11).collect()} == {"c" * 10}
    asked = spark.createDataFrame([(1, "gone")], "request long, output_id string")
    assert settings.read_back(asked, settings.originals(outputs)).first().text is None


def test_small_predicates(spark):
    assert one(spark, guards.holds_input_note, '{"c":"[3 characters of this earlier call\'s input left out] x"}', '{"c":"say [3 characters of this earlier call\'s input left out] x"}', "{}") == [True, False, False]
    assert one(spark, guards.spelled_out, "printf '\\\\x41\\\\x42\\\\x43' %44%45%46 0x47, 0x48, 0x49 \\\\101\\\\102\\\\103") == [["ABC", "DEF", "GHI", "ABC"]]
    assert one(spark, T.is_prose_assignment, "the password is kept in the vault of the team", "hunter22x") == [True, False]
    assert one(spark, hidden.reveal, "a​​b") == ["a[hidden characters]b"]


def test_vendor_tokens(spark):
    a43 = "Ab1" * 14 + "x"
    texts = [f"dp.st.dev_main.{a43}", f"dp.said.{a43}", f"dp.zz.{a43}", f"ntn_{a43}", f"secret_{a43}", f"secret_{a43}y", "dp.pt.short"]
    rows = spark.createDataFrame(list(enumerate(texts)), LINES)
    found = scan.scan(rows, [r for r in rules.DEFAULT_RULES if r.id in ("doppler-token", "notion-token", "notion-secret")]).collect()
    assert sorted((r.doc_id, r.rule_id) for r in found) == [(0, "doppler-token"), (1, "doppler-token"), (3, "notion-token"), (4, "notion-secret")]


def test_scan_takes_keys_named_as_its_own_columns(spark):
    rows = spark.createDataFrame([(1, 2, "zip 12345"), (3, 4, None), (5, 6, "")], "pattern long, k long, text string")
    got = scan.scan(rows, [rules.Rule("r", "pii", "[0-9]{5}")], keys=("pattern", "k")).collect()
    assert [(r.pattern, r.k, r.value) for r in got] == [(1, 2, "12345")]
    assert scan.scan(rows, [], keys=("k",)).count() == 0 and scan.scan(rows.limit(0), rules.DEFAULT_RULES, keys=("k",)).count() == 0


def test_cutoffs_of_a_long_conversation(spark):
    sized = {1: [(k * 7919) % 90 for k in range(12_000)], 2: [0, 60, 3], 3: []}
    items = [(c, k, "assistant", "x" * 4 * s) for c, of in sized.items() for k, s in enumerate(of)] + [(3, 0, "user", "x")]
    want = set()
    for c, of in sized.items():
        cutoff = since = 0
        for n, s in enumerate(of):
            since += s
            if since >= 50 and (due := (n + 1 - 10) // 10 * 10) > cutoff:
                cutoff, since = due, 0
            want.add((c, n, cutoff))
    rows = spark.createDataFrame(items, "conv_id long, turn long, role string, text string")
    # the fold's steps are a plan of rows: an array that grows by a turn at a time was copied with each
    assert "aggregate(" not in conversations.cutoffs(rows, least=50)._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in conversations.cutoffs(rows, least=50).collect()} == want


def test_first_changed_block_works_its_blocks_out_once(spark):
    texts = [f"text {k} " + "w" * (k % 5) for k in range(200)]
    body = lambda all: json.dumps({"system": "s", "messages": [{"role": "user", "content": t} for t in all]})
    cases = [(texts, texts), (texts, [*texts[:150], "x", *texts[151:]]), (texts, texts[:120]), ([], texts[:1])]
    rows = spark.createDataFrame([(k, body(a), body(b)) for k, (a, b) in enumerate(cases)], "id long, previous string, missed string")
    found = rows.select("id", records.first_changed_block(F.col("previous"), F.col("missed"), 7).alias("f"))
    side = lambda k, of: (f"m{k}[0]", of[k][:7]) if k < len(of) else None
    got = {r.id: r.f and (r.f["index"], r.f.previous and tuple(r.f.previous), r.f.missed and tuple(r.f.missed)) for r in found.collect()}
    assert got == {0: None} | {i: (k + 1, side(k, cases[i][0]), side(k, cases[i][1])) for i, k in ((1, 150), (2, 120), (3, 0))}
    # before, a body was parsed anew for each item compared: its name stood within the lambda over the items
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("missed#") <= 6, plan.count("missed#")


def test_first_change_of_nulls(spark):
    rows = [(["a", "b"], ["a", "c"]), (["a"], ["a", "b"]), (["a", None], ["a"]), (["a"], ["a", None, "b"]), ([None], [None]), ([None], ["a"]), ([], []), (None, ["a"]), (None, None)]
    found = spark.createDataFrame(rows, "a array<string>, b array<string>").select(conversations.first_change(F.col("a"), F.col("b")))
    assert [r[0] for r in found.collect()] == [1, 1, 1, 1, None, 0, None, 0, None]


def test_values_of_one_shape_are_not_all_tried_at_each_span(spark, monkeypatch):
    spans_of, cut = learned._spans, []
    monkeypatch.setattr(learned, "_spans", lambda *of: cut.append(spans_of(*of)) or cut[-1])
    values = [(f"Name#{k:04d}", "r", s) for k in range(500) for s in (k % 7, k % 7 + 3)]
    texts = [(k, f"ask {'Name#' if k % 2 else 'NAME#'}{k * 37 % 600:04d} now", k % 11) for k in range(90)]
    found = learned.swapped_findings(spark.createDataFrame(texts, "doc_id long, text string, seen long"), spark.createDataFrame(values, "value string, rule_id string, since long"))
    got = sorted((r.doc_id, r.start, r.end, r.value) for r in found.collect())
    assert got == [(k, 4, 13, t[4:13]) for k, t, seen in texts if (n := k * 37 % 600) < 500 and n % 7 <= seen]
    assert cut[0].count() == len(texts)  # before: one for each value as well
