import sys

from modspark.plans.commands import main

sys.exit(main())
