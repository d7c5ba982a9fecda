"""python -m verdigris"""

import sys

from verdigris.cli import main

sys.exit(main())
