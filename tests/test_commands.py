"""Commands work out registered plans and write them."""

from pathlib import Path

import pytest

from cinderspark import commands
from cinderspark.plans import registry

DATA = Path("/root/testdata/sf0.001")


def test_commands_name_registered_plans(capsys):
    assert len(commands.COMMANDS) == 17
    assert all(p in registry.plans for _, plans in commands.COMMANDS.values() for p in plans)
    assert commands.main(["list"]) == 0 and "dnbr" in capsys.readouterr().out
    for wrong in (["nothing"], ["dnbr"]):
        with pytest.raises(SystemExit):
            commands.main(wrong)


@pytest.mark.skipif(not DATA.exists(), reason="the test tables are absent")
@pytest.mark.parametrize("kind", commands.FORMATS)
def test_a_command_writes_and_goes_on(spark, tmp_path, kind):
    plans = ["g3_class_areas", "g4_burned_total"]
    first = commands.run(spark, "dnbr", str(DATA), str(tmp_path), kind, plans[:1])
    assert first["results"]["g3_class_areas"]["rows"] == 7
    again = commands.run(spark, "dnbr", str(DATA), str(tmp_path), kind, plans, skip_done=True)["results"]
    assert again["g3_class_areas"]["rows"] is None and again["g4_burned_total"]["rows"] == 1
    with pytest.raises(ValueError):
        commands.run(spark, "dnbr", str(DATA), str(tmp_path), kind, ["s9_map_features"])
