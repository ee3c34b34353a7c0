import os
import sys

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")  # the network's products are small: threads would only wait for each other
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_llm import docs  # noqa: E402,F401
