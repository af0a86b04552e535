import sys

import pytest
from pyspark import cloudpickle


@pytest.fixture(autouse=True)
def functions_by_value(request):
    cloudpickle.register_pickle_by_value(sys.modules[request.module.__name__])
