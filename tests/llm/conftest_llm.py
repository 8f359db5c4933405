"""Names the test modules share with conftest."""

from importlib import util
from pathlib import Path

_spec = util.spec_from_file_location("_llm_conftest", Path(__file__).with_name("conftest.py"))
_module = util.module_from_spec(_spec)
_spec.loader.exec_module(_module)
DOCS, ODD, make, prose = _module.DOCS, _module.ODD, _module.make, _module.prose
