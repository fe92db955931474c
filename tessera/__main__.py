import sys

from tessera.jobs import main

sys.exit(main())
