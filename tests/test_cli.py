import io
import json
import threading
import urllib.error
import urllib.request

import pytest

from markovmill.cli import main
from markovmill.service import Service

TEXT = 'the cat sat on the mat<|document|>the dog sat on the log<|document|>a "cat and a dog<|document|>the cat ran home'


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("cli")
    main(["new", str(folder)], spark, out=io.StringIO())
    (folder / "text.txt").write_text(TEXT)
    recipe = (folder / "recipe.txt").read_text().replace("new-model", "cats").replace("Experts 1/4", "Experts 1/2").replace("Centroids 2", "Centroids 1")
    (folder / "recipe.txt").write_text(recipe + "\nFile text.txt")
    out = io.StringIO()
    main(["build", str(folder / "recipe.txt")], spark, out=out)
    assert "cats" in out.getvalue()
    return str(folder / "cats")


def run(spark, *args, text=""):
    out = io.StringIO()
    main(list(args), spark, io.StringIO(text), out)
    return out.getvalue()


def test_run(spark, model):
    said = run(spark, "run", model, "-v", "--seed", "1", "--steps", "2", text="The cat\n")
    assert said.split("\n")[0] in ("sat on", "ran home", "ran", "sat") and "Active experts:" in said


def test_show(spark, model):
    said = run(spark, "show", model, text="the cat\nunknown\n")
    assert "Words: 13" in said and "'model.name'] = 'cats'" in said and "] sat" in said and "] ran" in said


def test_set_and_export(spark, model, tmp_path):
    run(spark, "set", model, "author", "me")
    assert "'author'] = 'me'" in run(spark, "show", model)
    tokens = run(spark, "export-tokens", model).splitlines()
    assert tokens[0] == "token,word" and len(tokens) == 14 and '2,"a"' in tokens
    transitions = run(spark, "export-transitions", model).splitlines()
    assert transitions[0] == "from,to,weight" and all(t.startswith('"[') for t in transitions[1:])
    run(spark, "export-tokens", model, "--to", str(tmp_path / "t"))
    written = [x for f in (tmp_path / "t").glob("part-*") for x in f.read_text().splitlines()]
    assert set(written) == set(tokens)


def test_help_and_errors(spark):
    assert "export-transitions" in run(spark, "help")
    with pytest.raises(SystemExit):
        main(["bogus"], spark)


def test_service(spark, model):
    s = Service(spark, seed=1)
    assert s.respond("POST", "/api/v1/stats") is None and s.respond("GET", "/api/v1/other") is None and s.respond("GET", "/") is None
    assert s.respond("GET", "/api/v1/load")["error"] == "no model given"
    assert s.respond("GET", "/api/v1/load?model=/nowhere")["error"] == "the model can't be read"
    assert s.respond("GET", f"/api/v1/generate?model={model}&query=x")["error"] == "load the model first"
    loaded = s.respond("GET", f"/api/v1/load?model={model}")
    assert loaded == {"status": "success"} and s.respond("GET", f"/api/v1/generate?model={model}")["error"] == "no query given"
    stats = s.respond("GET", "/api/v1/stats")["stats"][0]
    assert stats["model"]["tokens"]["len"] == 13 and len(stats["model"]["experts"]) == 2 and stats["stats"]["requests"]["count"] == 0
    s.models[model].model.keys["model.inference.max_tokens"] = "4"
    server = s.serve("127.0.0.1:0")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_address[1]}/api/v1/"
    said = json.load(urllib.request.urlopen(f"{at}generate?model={model}&query=the%20cat", timeout=120))
    assert said["status"] == "success" and said["response"].split()[0] in ("sat", "ran")
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(f"{at}nothing", timeout=10)
    server.shutdown()
    assert s.models[model].requests == 1
    assert s.respond("GET", f"/api/v1/unload?model={model}") == {"status": "success"} and not s.models
