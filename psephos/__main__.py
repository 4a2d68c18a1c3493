from psephos.plans.cli import main

main()
