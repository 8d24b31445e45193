"""Page ranges, options, sizes and redaction against tables of expected values."""

import json

import pytest
from pyspark.sql import functions as F

from vellum.functions import options as O, page_ranges as PR, records as R, redact

GOOD = {"3": "3", "12,14-20": "12,14-20", "\t6 ,  8-9\n": "6,8-9", "11-11": "11-11", "0-0,1": "0-0,1", "00042": "42",
        "1-2000": "1-2000", "0" * 30 + "9": "9", "1-" + "0" * 25 + "5": "1-5", "000": "0"}
BAD = {" ": "empty", "": "empty", "4,,5": "empty element", "4,": "empty element", "first": "not a page", "4-": "not a page", "-4": "not a page",
       "4-5-6": "not a page", "8-3": "counts backwards", "4.0": "not a page", "4 5": "not a page", "+4": "not a page", "４": "not a page",
       "5-100000000000": "past the maximum page index", "1-2001": "covers more than", "1" * 25: "past the maximum",
       "1" * 25 + "-7": "counts backwards", "0" * 25 + "8-3": "counts backwards", "?,8-3": "not a page", "8-3,?": "counts backwards",
       ",".join(["0-1999", "7"]): "covers more than"}


def test_page_ranges(value):
    specs = list(GOOD) + list(BAD)
    got = value([(s,) for s in specs], "s string", PR.parse_page_range(F.col("s")))
    for spec, r in zip(specs, got):
        if spec in GOOD:
            assert (r.ok, r.normalised, r.error) == (True, GOOD[spec], None), spec
        else:
            assert not r.ok and r.normalised is None and BAD[spec] in r.error, (spec, r)


def test_clamping_and_counting(value):
    rows = [("2-9", 6), ("0,3,5-8", 7), ("4-5,9", 30), ("8", 8), ("20,3,4-6,5,4", 50), ("1-9,2-3", 50)]
    iv = PR.parse_page_range(F.col("s")).intervals
    assert value(rows, "s string, n int", PR.clamp_range(iv, F.col("n"))) == ["2-5", "0,3,5-6", "4-5,9", None, "3-6,20", "1-9"]
    assert value(rows, "s string, n int", PR.range_size(iv)) == [8, 6, 3, 1, 7, 11]
    assert value(rows, "s string, n int", PR.selected_count(iv, F.col("n"))) == [4, 4, 3, 0, 5, 9]
    assert value(rows, "s string, n int", PR.page_indices(iv))[4] == [3, 4, 5, 6, 20]


def test_job_sizes(value):
    rows = [(166, None), (166, 10), (10, 100), (None, None), (None, 5)]
    pages = R.job_pages(F.col("p"), F.col("r"))
    assert value(rows, "p int, r int", pages) == [166, 10, 10, None, 5]
    assert value(rows, "p int, r int", R.job_timeout(pages)) == [31680, 3600, 3600, 21600, 2700]
    assert value(rows, "p int, r int", R.job_timeout(pages, 600)) == [600] * 5


def test_options(value):
    cases = [
        ({"output_format": "html", "page_range": "2 ,3-8 ", "force_ocr": False}, None),
        (None, None), ({"page_range": ""}, None), ({"page_range": None, "use_llm": None}, None),
        ({"output_format": "docx"}, "output_format must be one of"), ({"output_format": None}, "output_format must be"),
        ({"force_ocr": 1}, "force_ocr must be a bool"), ({"output_dir": []}, "output_dir must be a str"),
        ({"threads": 4, "debug": True}, "debug, threads"), ({"page_range": "8-3"}, "counts backwards"),
        ({"use_llm": True}, "no LLM is configured"), ("text", "must be a dict"), ("{", "must be a dict"),
    ]
    rows = [(None if o is None else o if o == "{" else json.dumps(o),) for o, _ in cases]
    got = value(rows, "o string", O.validate_options(F.col("o")))
    for (sent, error), r in zip(cases, got):
        assert (r.error is None) if error is None else (error in r.error), (sent, r)
    assert got[0].resolved == {"output_format": "html", "page_range": "2,3-8", "force_ocr": "false"}
    assert got[1].resolved == {} and got[2].resolved == {"page_range": ""}


def test_a_model_comes_from_the_deployment_alone(value):
    assert O.model_config(" ") == O.model_config(None) == {}
    own = O.model_config("\tOllama", base_url="http://gpu:1/", api_key="unused")
    assert own["ollama_base_url"] == "http://gpu:1" and set(own) == {"llm_service", "ollama_base_url"}
    hosted = O.model_config("openai", model=" m ")
    assert hosted["openai_model"] == "m" and hosted["openai_base_url"] and hosted["openai_api_key"]
    with pytest.raises(O.InvalidOption, match="ollama, openai"):
        O.model_config("other")
    rows = [('{"use_llm":true}',), ('{"use_llm":false}',), ('{"use_llm":true,"ollama_base_url":"http://elsewhere/"}',)]
    got = value(rows, "o string", O.validate_options(F.col("o"), own))
    assert got[0].resolved["ollama_base_url"] == "http://gpu:1"
    assert "llm_service" not in got[1].resolved and "ollama_base_url" in got[2].error


def test_redaction(value):
    hidden = "[redacted]"
    argvs = [["run", "--vault_token", "hush", "--n", "3"], ["--db_password=hush"], ["/usr/bin/run", "/data/api_key-notes.pdf", "--output_dir", "/r"],
             ["run", "--proxy", "https://me:hush@gate:1/p", "--via=ftp://hush@gate/q", "https://open.example/x@y"], None]
    assert value([(a,) for a in argvs], "a array<string>", redact.redact_argv(F.col("a"))) == [
        ["run", "--vault_token", hidden, "--n", "3"], [f"--db_password={hidden}"], argvs[2],
        ["run", "--proxy", f"https://{hidden}@gate:1/p", f"--via=ftp://{hidden}@gate/q", "https://open.example/x@y"], []]
    assert value([("ftp://me:a@b@gate/p?to=c@d",)], "u string", redact.redact_url(F.col("u"))) == [f"ftp://{hidden}@gate/p?to=c@d"]
    secret = ["vault_TOKEN", "my_api_key", "the_secret_one", "Password", "cloud_credential"]
    plain = {"proxy": "https://me:hush@gate/p", "output_format": "html"}
    (got,) = value([(dict.fromkeys(secret, "hush") | plain,)], "o map<string,string>", redact.redact_options(F.col("o")))
    assert got == dict.fromkeys(secret, hidden) | {"proxy": f"https://{hidden}@gate/p", "output_format": "html"}


def test_pairs_and_versions(value):
    rows = [(["a=1", "b=x=y", "a=2"],), (["nokey"],), (["=v"],), (["marker-pdf="],)]
    pairs = R.pairs_map(F.col("p"), "option")
    got = value(rows, "p array<string>", pairs)
    assert got[0].pairs == {"a": "2", "b": "x=y"} and "nokey" in got[1].error and "=v" in got[2].error
    assert value(rows, "p array<string>", R.versions_map(pairs.pairs, ["marker-pdf", "torch"]))[3] == {
        "marker-pdf": "unknown", "torch": "absent"}


def test_hashes_and_sizes(value):
    assert value([("abc",), ("",)], "s string", R.content_hash(F.col("s"))) == [
        "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad",
        "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"]
    assert value([(512,), (1536,), (5 * 1024 ** 3,), (3000 * 1024 ** 4,)], "n bigint", R.human_size(F.col("n"))) == [
        "512B", "1.5K", "5.0G", "3000.0T"]
