"""The registry in YAML: forms by hand, against a YAML library where there is one, and through the writer."""

import random

import pytest

from tidemark.sources import registry_file

BY_HAND = '''
# registry
sources:
  - id: "a"          # first
    name: 'D''Oeste: diário'
    base_url: https://www.a.example/x?y=1#z
    allowed_hosts: ["a.example", 'b, c', plain]
    seed_urls: []
    official: yes
    trust_level: 2
    limitations: "linha um
      segue aqui \\
      junto\\tfim # não é comentário"
    link_pattern: "(?i)a|\\\\.pdf(?:$|\\\\?)"
  # between
  - id: b
    name: texto simples
      em duas linhas   # com comentário
    base_url: ~
    enabled: off
    allowed_hosts:
      - one.example
      - "two: #2"
      -   um texto
          longo
    seed_urls:
    - http://same.example/indent
    limitations: 'uma

      outra'
    priority: not a number
    unknown: x
'''


def test_forms_by_hand():
    a, b = registry_file.entries(BY_HAND)
    assert a == {"id": "a", "name": "D'Oeste: diário", "base_url": "https://www.a.example/x?y=1#z", "allowed_hosts": ["a.example", "b, c", "plain"], "seed_urls": [], "official": "yes",
                 "trust_level": "2", "limitations": "linha um segue aqui junto\tfim # não é comentário", "link_pattern": "(?i)a|\\.pdf(?:$|\\?)"}
    assert b == {"id": "b", "name": "texto simples em duas linhas", "base_url": None, "enabled": "off", "allowed_hosts": ["one.example", "two: #2", "um texto longo"],
                 "seed_urls": ["http://same.example/indent"], "limitations": "uma\noutra", "priority": "not a number", "unknown": "x"}
    assert registry_file.entries("") == registry_file.entries("sources:\n") == registry_file.entries("# nothing") == registry_file.entries("sources: []") == []
    assert registry_file.entries("- id: x\n  n: [[a, b], [c]]\n") == [{"id": "x", "n": [["a", "b"], ["c"]]}]
    for refused in ("sources:\n- id: &a x", "sources:\n- id: {a: b}", "sources:\n- id: |\n    x", "sources:\n - id: a\n- id: b"):
        with pytest.raises(ValueError):
            registry_file.entries(refused)


def _word(r):
    return "".join(r.choice("abc é'\"\\:#-,[]{}&*!|>%@`?~\n\t😀 ") for _ in range(r.randrange(0, 90))) + r.choice(["", " fim", "x", ": y", " #z"])


def test_as_a_library_writes_it():
    yaml = pytest.importorskip("yaml")
    r = random.Random(5)
    rows = [{"id": f"s{i}", "name": _word(r), "hosts": [_word(r) for _ in range(r.randrange(3))], "limits": " ".join(_word(r) for _ in range(4))} for i in range(300)]
    for style in (None, "'", '"'):
        text = yaml.safe_dump({"sources": rows}, allow_unicode=True, sort_keys=False, width=120, default_style=style)
        got = registry_file.entries(text)
        for want, have in zip(rows, got, strict=True):
            assert have == want


def test_typed_and_round_trip(spark, tmp_path):
    (tmp_path / "by_hand.yaml").write_text(BY_HAND, encoding="utf-8")
    rows = {r.id: r for r in registry_file.read(spark, str(tmp_path / "by_hand.yaml")).collect()}
    assert rows["a"].official is True and rows["a"].trust_level == 2 and rows["a"].allowed_hosts == ["a.example", "b, c", "plain"] and rows["a"].priority == 10
    assert rows["b"].enabled is False and rows["b"].priority is None and rows["b"].max_documents == 10 and rows["b"].base_url is None and rows["b"].adapter == "generic"
    r = random.Random(9)
    made = spark.createDataFrame([(f"s{i}", i % 7, None if i % 11 == 0 else _word(r), [_word(r) for _ in range(i % 3)], i % 2 == 0) for i in range(200)],
                                 "id string, priority int, limitations string, allowed_hosts array<string>, enabled boolean")
    for parts in (1, 4):
        path = str(tmp_path / f"out{parts}")
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        registry_file.write(made, path)
        back = registry_file.read(spark, path, "id string, priority int, limitations string, allowed_hosts array<string>, enabled boolean")
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, made.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    empty = str(tmp_path / "empty")
    registry_file.write(made.limit(0), empty)
    assert registry_file.read(spark, empty).count() == 0
