import json
import sys
from datetime import datetime, timedelta, timezone

import pytest
from pyspark import cloudpickle

from pressloom import cli
from pressloom.engine import Engine
from pressloom.settings import Preferences, Settings, SettingsError, load_settings
from pressloom.sources.fetch import Response

NOW = datetime(2025, 3, 1, 12, tzinfo=timezone.utc)
ITEM = "<item><title>{}</title><link>https://{}.example/{}</link><description>{}</description><pubDate>Sat, 01 Mar 2025 0{}:00:00 GMT</pubDate></item>"
BODIES = {
    "https://a.example/rss": [ITEM.format("Chip maker Acme unveils faster graphics card", "a", 1, "Acme showed a graphics card for the Linux kernel on Saturday in the city hall.", 8), ITEM.format("Council votes on the harbor", "a", 2, "The council votes today.", 7)],
    "https://b.example/rss": [ITEM.format("Chip maker Acme unveils new faster graphics card", "b", 1, "A new card of Acme for the Linux desktop was shown.", 9), ITEM.format("Chip maker Acme unveils new faster graphics card", "b", "1?utm_source=x", "Short.", 9)],
}


def answer(url, headers):
    if url not in BODIES:
        raise OSError("no route")
    return Response(304) if headers.get("If-None-Match") else Response(200, f"<rss><channel>{''.join(BODIES[url])}</channel></rss>".encode(), "tag")


def test_engine_from_feeds_to_briefing(spark, tmp_path):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    registry = tmp_path / "r.json"
    registry.write_text(json.dumps({"sources": [{"id": x, "name": x.upper(), "url": f"https://{x}.example/rss", "lean": lean} for x, lean in (("a", "left"), ("b", "right"), ("c", "center"))]}))
    engine = Engine(spark, str(tmp_path / "data"))
    assert engine.sync_registry(str(registry)) is None and "No such file" in engine.sync_registry(str(tmp_path / "none.json"))
    done = engine.refresh(NOW, answer)
    assert (done["sources_ok"], done["sources_failed"], done["inserted"], done["clusters"]) == (2, 1, 3, 1) and "3 new" in done["report"]
    again = engine.refresh(NOW + timedelta(hours=1), answer)
    assert (again["sources_not_modified"], again["inserted"], again["updated"]) == (2, 0, 0)
    rows = {r["url"]: r for r in engine._table("articles").collect()}
    assert len(rows) == 3 and rows["https://a.example/1"]["cluster_id"] == rows["https://b.example/1"]["cluster_id"] != ""
    out = engine.ask("What did Acme unveil?", NOW)
    assert out["cited"] and "Acme" in out["answer"] and out["sources"][0]["n"] == 1
    more = engine.ask("how are different sources covering it", NOW, out["session"])
    assert more["intent"] == "compare_coverage" and "**Classified not applicable**" in more["answer"] and len(engine.turns(out["session"])) == 4
    engine.forget(out["session"])
    assert engine.turns(out["session"]) == []
    Preferences(["Linux", "linux", " "]).save(engine._path("preferences.json"))
    made = engine.briefing(NOW)
    assert made["story_count"] == 1 and json.loads(made["payload"])["sections"][0]["name"] == "Linux" and json.loads(made["payload"])["sections"][0]["stories"][0]["source_count"] == 2
    state = engine.status(NOW)
    assert state["n_articles"] == 3 and state["failing"][0]["source_id"] == "c" and not state["briefing_stale"] and state["interests"] == ["Linux"]
    late = NOW + timedelta(days=40)
    assert engine.refresh(late, answer, only=["c"])["pruned"] == 3
    assert engine.briefing(late)["empty_reason"] == "no articles have been ingested yet" and engine.status(late + timedelta(days=2))["briefing_stale"]
    args = cli.parser().parse_args(["--folder", "x", "configure", "space"])
    assert cli.run(engine, args, NOW) == ["space"] and "n_articles: 0" in cli.shown(cli.run(engine, cli.parser().parse_args(["--folder", "x", "status"]), NOW))


def test_settings(tmp_path):
    file = tmp_path / "s.toml"
    file.write_text("retention_days = 7\nlookback = 12\n")
    got = load_settings(str(file), {"PRESSLOOM_LOOKBACK": "24", "OTHER": "1"})
    assert (got.retention_days, got.lookback) == (7, 24.0)
    for bad in ({"nope": 1}, {"per_feed": "many"}):
        with pytest.raises(SettingsError):
            Settings().with_values(bad)
    assert Preferences.load(str(tmp_path / "none")).onboarded is False
