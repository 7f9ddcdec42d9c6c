import sys

from weftgraph.cli import main

sys.exit(main())
