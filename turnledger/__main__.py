import sys

from turnledger.cli import main

sys.exit(main())
