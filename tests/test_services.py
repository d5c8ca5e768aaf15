"""Services against a server of this test's own."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tessera.functions import models, services
from tessera.operators import prompt
from tessera.plans.retrieval import QAPipeline


@pytest.fixture(scope="module")
def server():
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            if self.path == "/api/generate":
                asked = json.loads(body)
                reply = {"response": f" {asked['model']}:{asked['prompt']}:{asked['options']['temperature']}:{asked['stream']} "}
            elif self.path == "/v1/chat/completions" and self.headers["Authorization"] == "Bearer secret":
                reply = {"choices": [{"message": {"content": json.loads(body)["messages"][1]["content"].upper()}}]}
            elif self.path == "/v1/audio/transcriptions":
                reply = {"text": f"{len(body.split(b'octet-stream')[1].split(b'--')[0].strip())} bytes, {'a.wav' if b'a.wav' in body else '?'}"}
            elif self.path == "/odd/api/generate":
                reply = {"other": 1}
            else:
                self.send_error(403)
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(reply).encode())

        def log_message(self, *_):
            pass

    made = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}"
    made.shutdown()


def test_completions_in_a_plan(spark, server):
    generate = models.generator("test-completions", services.completions(server, "m"))
    rows = spark.createDataFrame([(1, "hi"), (2, None)], "i long, prompt string").select("i", generate("prompt").alias("answer")).collect()
    assert {r["i"]: r["answer"] for r in rows} == {1: "m:hi:0.2:False", 2: None}


def test_replies_that_are_none(server):
    for url in (f"{server}/odd", f"{server}/nowhere", "http://127.0.0.1:1"):
        with pytest.raises(services.ServiceError):
            services.completions(url, "m")()(["hi"])


def test_chat_and_speech_need_a_key(server, monkeypatch):
    ask = services.chat(f"{server}/v1", "m", "TESSERA_TEST_KEY")()
    monkeypatch.delenv("TESSERA_TEST_KEY", raising=False)
    assert ask(["hi"]) == [services.NO_KEY]
    with pytest.raises(services.ServiceError):
        services.transcribe(f"{server}/v1", "w", "TESSERA_TEST_KEY", b"sound")
    monkeypatch.setenv("TESSERA_TEST_KEY", "secret")
    assert ask(["hi", "you"]) == ["HI", "YOU"]
    assert services.transcribe(f"{server}/v1", "w", "TESSERA_TEST_KEY", b"sound", "a.wav") == "5 bytes, a.wav"
    monkeypatch.setenv("TESSERA_TEST_KEY", "wrong")
    with pytest.raises(services.ServiceError, match="403"):
        ask(["hi"])


def test_a_service_is_told_what_it_does(spark):
    def service(system):
        return lambda: lambda prompts: [services.NO_KEY if p == "no key" else f"{system}|{p}" for p in prompts]

    plan = QAPipeline(None).served("test-service", service)
    rows = spark.createDataFrame([(1, "hi"), (2, "no key"), (3, None)], "i long, p string").select("i", plan.generate(F.col("p")).alias("answer"), plan.condense(F.col("p")).alias("condensed")).collect()
    got = {r["i"]: (r["answer"], r["condensed"]) for r in rows}
    assert got == {1: (f"{prompt.SYSTEM_PROMPT}|hi", f"{prompt.CONDENSE_PROMPT}|hi"), 2: (services.NO_KEY, None), 3: (None, None)}
