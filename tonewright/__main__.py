import sys

from tonewright.cli import main

sys.exit(main())
