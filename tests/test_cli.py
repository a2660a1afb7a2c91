import pytest

from inkwell.__main__ import load_config, main


def test_config(tmp_path):
    good = tmp_path / "good.toml"
    good.write_text('vault = "notes"\nindex = "index"\ntarget_tokens = 100\n')
    assert load_config(str(good))["vault"] == str(tmp_path / "notes")
    assert main(["--config", str(good), "check-config"]) == 0
    for text in ('vault = "n"', 'vault = "n"\nindex = "i"\nother = 1', 'vault = "n"\nindex = 3', 'vault = "n"\nindex = "i"\ntarget_tokens = true'):
        bad = tmp_path / "bad.toml"
        bad.write_text(text)
        with pytest.raises(ValueError):
            load_config(str(bad))
        assert main(["--config", str(bad), "check-config"]) == 2
